"""Schema checks, rejects and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.schemas import KEYS


def require(df: DataFrame, columns: list[str], table: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} is missing columns: {missing}")
    return df


def split_rejects(df: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows with usable keys, rows with a null or blank key and the reason)."""
    bad = None
    for key in keys:
        empty = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
        test = F.when(empty, F.lit(f"empty {key}"))
        bad = test if bad is None else F.coalesce(bad, test)
    marked = df.withColumn("reject_reason", bad)
    return (
        marked.where("reject_reason is null").drop("reject_reason"),
        marked.where("reject_reason is not null"),
    )


def valid_store_id(column: str = "store_id"):
    return F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")


def store_ids(inventory: DataFrame) -> DataFrame:
    return inventory.select(F.col("store_id").cast("string").alias("store_id")).distinct()


def schema_report(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type) of a table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns and nulls per column, in one pass: (column_name, row_count, nulls)."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.select(
        "_rows",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in names])).alias("x"),
    ).select("x.column_name", F.col("_rows").alias("row_count"), "x.nulls")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
