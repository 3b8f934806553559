"""SQL tables, versioned tables and the dataset registry."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larder.schemas import KEYS
from larder.sources.files import empty, path_exists, publish, read_csv, read_dataset, remove, subfolders, touch


def load_table(spark: SparkSession, csv_path: str, schema: T.StructType, table: str = "inventory", managed: bool = False) -> DataFrame:
    """Load a CSV into a SQL table, replacing what was there."""
    df = read_csv(spark, csv_path, schema)
    if managed:
        df.write.mode("overwrite").saveAsTable(table)
    else:
        df.createOrReplaceTempView(table)
    return spark.table(table)


def save_bucketed(df: DataFrame, table: str, buckets: int, keys: list[str] = KEYS) -> DataFrame:
    """Save a managed table bucketed and sorted on its keys.

    Tables with the same bucket count join on those keys without a shuffle, which pays
    off for inventory, forecast and pricing: nearly every job joins them by product and store.
    """
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def scan_table(spark: SparkSession, table: str = "inventory") -> DataFrame:
    return spark.table(table)


class ForeignVersion(RuntimeError):
    """A version that this writer was about to publish has been published by another one."""


class VersionedTable:
    """A table that is rewritten as a whole while it may still be read.

    Each write goes to a folder of its own and is published by renaming that folder to the next version,
    which fails if the version exists. So a writer that dies leaves nothing a reader or a later
    writer would meet, and of two writers that start from the same version one fails.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int | None:
        names = [n for n in subfolders(self.spark, self.path) if n.startswith("v=")]
        return max((int(n[2:]) for n in names), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version is None:
            return empty(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def write(self, df: DataFrame, version: int | None = None, owner: str | None = None) -> int:
        """Publish ``df`` as the next or the given version.

        With an ``owner`` a write may be run again: a version the same owner has published stays as it is. A version of
        anyone else is an error.
        """
        version = self._next() if version is None else version
        target = f"{self.path}/v={version}"
        if owner is not None and path_exists(self.spark, target):
            return self._owned(target, version, owner)
        unpublished = f"{self.path}/_writing-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.mode("error").parquet(unpublished)
        if owner is not None:
            touch(self.spark, f"{unpublished}/_owner-{owner}")
        try:
            publish(self.spark, unpublished, target)
        except Exception:
            if owner is None or not path_exists(self.spark, target):
                raise
            remove(self.spark, unpublished)
            return self._owned(target, version, owner)
        return version

    def _owned(self, target: str, version: int, owner: str) -> int:
        if not path_exists(self.spark, f"{target}/_owner-{owner}"):
            raise ForeignVersion(f"version {version} of {self.path} was published by another writer")
        return version

    def retire(self, below: int) -> None:
        """Remove the versions below ``below``; no reader may use them any more."""
        for name in subfolders(self.spark, self.path):
            if name.startswith("v=") and int(name[2:]) < below:
                remove(self.spark, f"{self.path}/{name}")

    def _next(self) -> int:
        """After every version folder there is, finished or not."""
        names = [n for n in subfolders(self.spark, self.path, finished=False) if n.startswith("v=")]
        return max((int(n[2:]) for n in names), default=0) + 1

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Read, change, write the next version."""
        return self.write(change(self.read()))


@dataclass
class Dataset:
    path: str
    schema: T.StructType
    kind: str = "parquet"
    on_missing: str = "empty"


@dataclass
class Registry:
    """Named datasets, read lazily; ``cached`` keeps one persisted for ``ttl`` seconds."""

    spark: SparkSession
    datasets: dict[str, Dataset]
    ttl: float = 300.0
    clock: Callable[[], float] = time.monotonic
    _kept: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def read(self, name: str) -> DataFrame:
        d = self.datasets[name]
        return read_dataset(self.spark, d.path, d.schema, d.on_missing, d.kind)

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in self.datasets}

    def cached(self, name: str) -> DataFrame:
        kept = self._kept.get(name)
        if kept is None or self.clock() - kept[0] >= self.ttl:
            return self.refresh(name)
        return kept[1]

    def refresh(self, name: str) -> DataFrame:
        old = self._kept.pop(name, None)
        if old is not None:
            old[1].unpersist()
        df = self.read(name).persist()
        self._kept[name] = (self.clock(), df)
        return df

    def register_views(self) -> None:
        for name, df in self.load_all().items():
            df.createOrReplaceTempView(name)
