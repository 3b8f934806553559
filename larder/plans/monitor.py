"""Inventory monitoring: counts, classes, KPIs and the rows behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.stock import days_to_expiry, expires_within, stock_balance, stock_class, stockout_risk
from larder.operators.checks import require
from larder.operators.summaries import as_metrics, conditional_counts, shares

MONITOR_CAPACITY = 20
KPI_CAPACITY = 10

# Report lines.
REPORT_LINES = {
    "stockout_risk": "Stockout risk: %d items",
    "expiring_soon": "Expiring soon: %d items",
    "low_capacity": "Low warehouse capacity items: %d",
}


def stockouts(inventory: DataFrame, inclusive: bool = False) -> DataFrame:
    return inventory.where(stockout_risk(F.col("stock_levels"), F.col("reorder_point"), inclusive))


def expiring(inventory: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return inventory.where(expires_within(F.col("expiry_date"), as_of, days))


def low_capacity(inventory: DataFrame, below: int = MONITOR_CAPACITY) -> DataFrame:
    return inventory.where(F.col("warehouse_capacity") < below)


def inventory_report(inventory: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(metric, items): stockout risk, expiring soon, low capacity; one pass."""
    require(inventory, ["stock_levels", "reorder_point", "expiry_date", "warehouse_capacity"], "inventory")
    counts = conditional_counts(
        inventory,
        {
            "stockout_risk": stockout_risk(F.col("stock_levels"), F.col("reorder_point")),
            "expiring_soon": expires_within(F.col("expiry_date"), as_of, days),
            "low_capacity": F.col("warehouse_capacity") < MONITOR_CAPACITY,
        },
    )
    return as_metrics(counts)


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text lines (``value``), ready for the text sink."""
    line = None
    for name, template in REPORT_LINES.items():
        text = F.format_string(template, F.col("items"))
        line = F.when(F.col("metric") == name, text) if line is None else line.when(F.col("metric") == name, text)
    return report.select(line.alias("value"))


def stock_status(inventory: DataFrame, low: int = 10, over: int = 300) -> DataFrame:
    return inventory.withColumn("stock_class", stock_class(F.col("stock_levels"), low, over))


def kpis(inventory: DataFrame, product_id=None, store_id=None, as_of: str | None = None) -> DataFrame:
    """One row of dashboard KPIs for a product and store (or all): inclusive stockouts,
    expiry within 30 days, capacity below 10.

    Without a ``days_to_expiry`` column the expiry is counted from ``as_of``, which must be given.
    """
    if as_of is None and "days_to_expiry" not in inventory.columns:
        raise ValueError("kpis needs as_of, or a days_to_expiry column")
    rows = inventory
    if product_id is not None:
        rows = rows.where(F.col("product_id") == product_id)
    if store_id is not None:
        rows = rows.where(F.col("store_id") == store_id)
    left = F.col("days_to_expiry") if "days_to_expiry" in inventory.columns else days_to_expiry(F.col("expiry_date"), as_of)
    return conditional_counts(
        rows,
        {
            "stockout_risk": stockout_risk(F.col("stock_levels"), F.col("reorder_point"), inclusive=True),
            "expiring_soon": left <= 30,
            "low_capacity": F.col("warehouse_capacity") < KPI_CAPACITY,
        },
    )


def balance_rows(inventory: DataFrame) -> DataFrame:
    """Rows above or below their reorder point with ``status``; equal rows are in neither."""
    return inventory.withColumn("status", stock_balance(F.col("stock_levels"), F.col("reorder_point"))).where(
        "status is not null"
    )


def balance_shares(inventory: DataFrame) -> DataFrame:
    return shares(inventory, stock_balance(F.col("stock_levels"), F.col("reorder_point")))


def expiry_shares(inventory: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    soon = F.coalesce(expires_within(F.col("expiry_date"), as_of, days), F.lit(False))
    return shares(inventory, F.when(soon, "Expiring Soon").otherwise("Not Expiring Soon"))
