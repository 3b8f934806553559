"""Joins between inventory, forecast, pricing and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.columns import align_keys
from larder.schemas import KEYS
from larder.session import stage


def match(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Inner join on the keys; repeated keys multiply. Join strategy is left to Catalyst and AQE."""
    left, right = align_keys(left, right, keys)
    return left.join(right, keys, "inner")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def match_suffixed(left: DataFrame, right: DataFrame, suffixes: tuple[str, str], keys: list[str] = KEYS) -> DataFrame:
    """Inner join; non-key columns found on both sides get a suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return match(left, right, keys)


def match_or_product(demand: DataFrame, inventory: DataFrame) -> DataFrame:
    """Join on product and store; if that finds nothing at all, on product alone.

    The exact join is staged, so its sides are built once and the second join only where the
    first is empty. Pass the columns that are needed, no more. The store of a product-only match
    is the inventory's.
    """
    demand, inventory = align_keys(demand, inventory)
    exact = stage(demand.join(inventory, KEYS, "inner"), "matched")
    if not exact.isEmpty():
        return exact
    return demand.drop("store_id").join(inventory, ["product_id"], "inner").select(*exact.columns)


def add_quantities(inventory: DataFrame, changes: DataFrame, qty: str = "reorder_qty", keys: list[str] = KEYS) -> DataFrame:
    """Add the summed quantity of each key to its stock level.

    Changes are summed per key before the join (partial sums on the map side), so a
    key with very many changes arrives as one row.
    """
    inventory, changes = align_keys(inventory, changes, keys)
    totals = changes.groupBy(*keys).agg(F.sum(qty).alias("_change"))
    level = F.col("stock_levels") + F.coalesce(F.col("_change"), F.lit(0))
    return (
        inventory.join(totals, keys, "left")
        .withColumn("stock_levels", level.cast(inventory.schema["stock_levels"].dataType))
        .select(*inventory.columns)
    )


def matched_only(changes: DataFrame, inventory: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    changes, inventory = align_keys(changes, inventory, keys)
    return changes.join(inventory.select(*keys), keys, "left_semi")


def unmatched_only(changes: DataFrame, inventory: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    changes, inventory = align_keys(changes, inventory, keys)
    return changes.join(inventory.select(*keys), keys, "left_anti")


def with_holidays(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """Left join to a holiday table. Its size decides whether it is broadcast."""
    return df.join(calendar.withColumnRenamed("date", date), [date], "left")


def product_filter(df: DataFrame, pattern: str | None, column: str = "product_id", literal: bool = False) -> DataFrame:
    """Keep ids in which the pattern is found; an empty pattern keeps all."""
    if not pattern:
        return df
    text = F.col(column).cast("string")
    return df.where(text.contains(pattern) if literal else text.rlike(pattern))


def members(df: DataFrame, ids: list | DataFrame, column: str = "product_id") -> DataFrame:
    """Keep rows whose id is in a list, or in a table (semi join)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column), column, "left_semi")
    return df.where(F.col(column).isin(ids))
