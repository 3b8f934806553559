"""Registration of the checked queries: a Spark job and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.views import Views, with_views
from larder.session import tune


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    job: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return plain(self.job(Views(tune(spark), folder)))


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, views: str = "", recursive: bool = False):
    """Register a job under ``name``; ``covers`` lists the operators it exercises."""

    def register(job: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            text = with_views(sql, *views.split(), recursive=recursive) if views else sql
        CATALOG[name] = Query(name, covers, job, text)
        return job

    return register


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that both engines show them alike."""
    dated = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType))]
    return df.withColumns({c: F.col(c).cast("string") for c in dated}) if dated else df


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round columns whose sums depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def load() -> dict[str, Query]:
    from checks import demand_queries, model_queries, stock_queries  # noqa: F401

    return CATALOG
