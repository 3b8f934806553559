"""Exact global row positions and what they give: holdouts and expanding folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import stage

# monotonically_increasing_id keeps the partition number above this bit.
_LOCAL_BITS = 33


def with_positions(df: DataFrame, order_by: list[str], position: str = "position") -> DataFrame:
    """Add the 0-based position of every row in the order of ``order_by``.

    Rows are range-partitioned on the whole order key plus a row tag, so a day or
    key that holds a large share of the table, or many equal rows, spreads over
    several ranges. The sorted ranges are staged once; the offsets table has one row per
    range, which bounds what is broadcast by the shuffle width, not by the data.
    """
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order_by, "_tie")
        .sortWithinPartitions(*order_by, "_tie")
        .drop("_tie")
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    staged = stage(ordered, "positions").withColumn("_range", F.shiftright("_slot", _LOCAL_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        staged.join(F.broadcast(offsets), "_range")
        .withColumn(position, F.col("_offset") + local)
        .drop("_range", "_slot", "_offset")
    )


DAYS = 100_000  # values of the first order column that may be offset by a broadcast table
DAY_ROWS = 10_000_000  # rows of one of them that are ranked in one task


def _placed(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, Column]:
    """(rows with ``position``, number of rows).

    Ranked in two levels where the first order column has few values, as dates have: counts per value give offsets, and
    rows are ranked inside their value, so one exchange places all rows. Where a single value holds very many
    rows, or there are very many values, the whole order key is range-partitioned.
    """
    first, *rest = order_by
    counts = stage(df.groupBy(F.col(first).alias("_day")).agg(F.count(F.lit(1)).alias("_rows")), "days")
    days, most, total = counts.agg(F.count(F.lit(1)), F.max("_rows"), F.sum("_rows")).first()
    if not rest or days > DAYS or (most or 0) > DAY_ROWS:
        return with_positions(df, order_by), F.lit(total or 0)
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("_day", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    rank = F.row_number().over(Window.partitionBy(first).orderBy(*rest)) - 1
    ranked = df.withColumn("_rank", rank).join(offsets, F.col(first).eqNullSafe(F.col("_day")))
    return ranked.withColumn("position", (F.col("_offset") + F.col("_rank")).cast("long")).drop("_day", "_offset", "_rank"), F.lit(total or 0)


def chronological_holdout(df: DataFrame, order_by: list[str], share: float = 0.2) -> DataFrame:
    """Mark the last trunc(n * share) rows in date order as the test part (``is_test``)."""
    positioned, total = _placed(df, order_by)
    test_rows = (total * F.lit(share)).cast("long")
    return positioned.withColumn("is_test", F.col("position") >= total - test_rows)


def expanding_folds(df: DataFrame, order_by: list[str], folds: int = 5) -> DataFrame:
    """Add ``fold``: k for rows validated in fold k, 0 for rows that only ever train.

    The test block is n // (folds + 1) rows; fold k trains on every row before its
    block. Rows left over by the division stay in the first training part.
    """
    positioned, total = _placed(df, order_by)
    block = F.floor(total / (folds + 1)).cast("long")
    start = total - block * F.lit(folds)
    nth = F.floor((F.col("position") - start) / F.nullif(block, F.lit(0))) + 1
    return positioned.withColumn("fold", F.when((F.col("position") < start) | (block == 0), F.lit(0).cast("long")).otherwise(nth).cast("int"))
