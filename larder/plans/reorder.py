"""Reorder suggestions, their application to stock, and the reorder log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.stock import SAFETY_SHARE, needs_reorder, picked_demand, reorder_qty, safety_stock
from larder.operators.checks import require, split_rejects
from larder.operators.columns import backfill_store, stamped, tag
from larder.operators.matching import add_quantities, match, match_or_product, matched_only, unmatched_only
from larder.schemas import KEYS

STOCK_COLUMNS = [*KEYS, "stock_levels", "reorder_point"]


def reorder_suggestions(
    forecast: DataFrame, inventory: DataFrame, safety: float = SAFETY_SHARE, fallback: bool = True
) -> DataFrame:
    """Rows whose stock is below the reorder point or the demand, with the quantity to order.

    Not sorted: see ``by_urgency``. ``fallback`` joins on the product alone when no
    product-store pair matches at all. Rows with a null or blank product or store take no
    part on either side: see ``suggestion_rejects``.
    """
    require(inventory, STOCK_COLUMNS, "inventory")
    lead = "lead_time_days" in inventory.columns
    stock = inventory.select(*STOCK_COLUMNS, *(["lead_time_days"] if lead else []))
    if not lead:
        stock = stock.withColumn("lead_time_days", F.lit(None).cast("int"))
    forecast = backfill_store(forecast, inventory, first=True)
    demand, _ = split_rejects(forecast.select(*KEYS, picked_demand(forecast.columns).alias("predicted_demand")))
    stock, _ = split_rejects(stock)
    joined = match_or_product(demand, stock) if fallback else match(demand, stock)
    level, point, need = F.col("stock_levels"), F.col("reorder_point"), F.col("predicted_demand")
    return joined.where(needs_reorder(level, point, need)).select(
        *KEYS,
        "stock_levels",
        "predicted_demand",
        "lead_time_days",
        safety_stock(need, safety).alias("safety_stock"),
        reorder_qty(need, level, safety).alias("reorder_qty"),
    )


def suggestion_rejects(forecast: DataFrame, inventory: DataFrame) -> DataFrame:
    """(table_name, product_id, store_id, reject_reason) of the rows ``reorder_suggestions`` refuses."""
    forecast = backfill_store(forecast, inventory, first=True)
    parts = []
    for name, df in (("forecast", forecast), ("inventory", inventory)):
        keys = [F.col(k).cast("string").alias(k) for k in KEYS]
        parts.append(split_rejects(df.select(*keys))[1].select(F.lit(name).alias("table_name"), *KEYS, "reject_reason"))
    return parts[0].unionByName(parts[1])


def by_urgency(suggestions: DataFrame) -> DataFrame:
    """Lowest stock first, product and store as tie-breakers."""
    return suggestions.orderBy("stock_levels", *KEYS)


def apply_reorders(suggestions: DataFrame, inventory: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inventory with ordered units added, processed suggestions, suggestions without stock row)."""
    require(suggestions, [*KEYS, "reorder_qty"], "suggestions")
    require(inventory, [*KEYS, "stock_levels"], "inventory")
    processed = tag(matched_only(suggestions, inventory), status="Auto-Reordered", processed_at=stamped(as_of))
    return add_quantities(inventory, suggestions), processed, unmatched_only(suggestions, inventory)


def reorder_log(suggestions: DataFrame, as_of: str, existing: DataFrame | None = None) -> DataFrame:
    """Suggestions stamped for the reorder log, after the rows already logged; missing columns are null."""
    rows = suggestions.withColumnsRenamed({"reorder_quantity": "reorder_qty"})
    rows = tag(rows, triggered_at=stamped(as_of), triggered_by="Auto-System")
    return rows if existing is None else existing.unionByName(rows, allowMissingColumns=True)


def reorder_plan(forecast: DataFrame, inventory: DataFrame, buffer: float = 10.0) -> DataFrame:
    """Rows below their reorder point with the order that covers demand plus a buffer."""
    demand = forecast.select(*KEYS, picked_demand(forecast.columns).alias("predicted_demand"))
    joined = match(demand, inventory.select(*STOCK_COLUMNS))
    return joined.where("stock_levels < reorder_point").select(
        *STOCK_COLUMNS,
        "predicted_demand",
        (F.col("predicted_demand") - F.col("stock_levels") + F.lit(buffer)).alias("recommended_qty"),
    )


def demand_gap_orders(forecast: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows whose stock is below demand, ordering just the difference (no safety share)."""
    rows = reorder_suggestions(forecast, inventory, safety=0.0)
    return rows.where("stock_levels < predicted_demand").select(
        *KEYS, "stock_levels", "predicted_demand", "lead_time_days", "reorder_qty"
    )


def with_demo_reorder_point(forecast: DataFrame, prediction: Column | str = "prediction") -> DataFrame:
    column = F.col(prediction) if isinstance(prediction, str) else prediction
    return forecast.withColumn("reorder_point", column * F.lit(0.9))
