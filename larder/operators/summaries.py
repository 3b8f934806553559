"""Whole-table reductions: KPIs, histograms, shares, pivots."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the count of each condition, in a single pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def as_metrics(one_row: DataFrame, name: str = "metric", value: str = "items") -> DataFrame:
    """Turn a one-row table into (name, value) rows."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in one_row.columns]
    return one_row.select(F.explode(F.array(*pairs)).alias("x")).select(f"x.{name}", f"x.{value}")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins are kept.

    Returns (bin, bin_start, bin_end, items). A column with a single value gets a
    range of one around it.
    """
    spark = df.sparkSession
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    span = bounds.select(F.struct("lo", "hi")).scalar()
    placed = values.withColumn("r", span).select(
        F.least(F.floor((F.col("v") - F.col("r.lo")) * bins / (F.col("r.hi") - F.col("r.lo"))), F.lit(bins - 1))
        .cast("int")
        .alias("bin")
    )
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("items"))
    edges = (
        spark.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .withColumn("r", span)
        .where("r.lo is not null")
        .select(
            "bin",
            (F.col("r.lo") + F.col("bin") * (F.col("r.hi") - F.col("r.lo")) / bins).alias("bin_start"),
            (F.col("r.lo") + (F.col("bin") + 1) * (F.col("r.hi") - F.col("r.lo")) / bins).alias("bin_end"),
        )
    )
    return edges.join(counted, "bin", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def shares(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    """Rows per bucket and their percentage; rows with a null bucket are left out."""
    counted = df.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("items")).where(F.col(name).isNotNull())
    total = df.where(bucket.isNotNull()).agg(F.count(F.lit(1)))
    return counted.withColumn("pct", F.col("items") * 100.0 / total.scalar())


def level_list(df: DataFrame, column: str) -> list[str]:
    """Distinct values of a column that is to become one column per value, sorted.

    The result is as wide as the table made from it; for a column with very many values use
    ``stock_maps`` or ``segment_vector``, which need no list.
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted((r[0] for r in found), key=str)


def stock_maps(inventory: DataFrame) -> DataFrame:
    """The stock matrix for any number of stores: one row per product with a map from store to level.

    A repeated key is an error.
    """
    cell = F.struct(F.col("store_id").cast("string").alias("store"), F.col("stock_levels").cast("long").alias("stock"))
    cells = F.sort_array(F.collect_list(cell))
    return inventory.groupBy("product_id").agg(F.map_from_entries(cells).alias("stock"))


def segment_vector(df: DataFrame, column: str = "customer_segments", output: str = "segment_vector") -> DataFrame:
    """0/1 features of a column with any number of levels as one sparse vector, levels in alphabetical order.

    A null gives all zeros.
    """
    code = f"_{output}_code"
    known = df.where(F.col(column).isNotNull())
    index = StringIndexer(inputCol=column, outputCol=code, stringOrderType="alphabetAsc", handleInvalid="keep").fit(known)
    encode = OneHotEncoder(inputCol=code, outputCol=output, dropLast=True).fit(index.transform(known))
    return encode.transform(index.transform(df)).drop(code)


def stock_matrix(inventory: DataFrame, stores: list | None = None) -> DataFrame:
    """Products down, stores across, stock level in the cells; a repeated key is an error."""
    stores = level_list(inventory, "store_id") if stores is None else stores
    cells = inventory.groupBy("product_id", "store_id").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate product and store")))
        .otherwise(F.first("stock_levels"))
        .cast("long")
        .alias("stock")
    )
    wide = cells.groupBy("product_id").pivot("store_id", stores).agg(F.first("stock"))
    return wide.toDF("product_id", *[f"store_{s}" for s in stores])


def daily_total(demand: DataFrame, date: str = "date", value: str = "sales_quantity") -> DataFrame:
    return demand.groupBy(date).agg(F.sum(value).alias(value))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows in an explicit order (distributed top-k, no full sort)."""
    return df.orderBy(*order).limit(n)
