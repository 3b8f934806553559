"""Stock audit against forecast, price flags and sales impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.ratios import impact_label, pct_change, price_status, safe_ratio
from larder.functions.stock import picked_demand, stock_gap
from larder.operators.checks import require, split_rejects
from larder.operators.columns import trim_headings
from larder.operators.matching import match, match_suffixed
from larder.schemas import KEYS


def audit(inventory: DataFrame, forecast: DataFrame, threshold: float = 20) -> DataFrame:
    """Rows whose stock is further than ``threshold`` from the forecast, flagged Mismatch.

    Rows without a usable product and store are left out on both sides.
    """
    require(inventory, [*KEYS, "stock_levels"], "inventory")
    rows = match(split_rejects(inventory)[0], split_rejects(forecast)[0])
    gap = stock_gap(F.col("stock_levels"), picked_demand(forecast.columns))
    return rows.withColumn("stock_gap", gap).where(F.col("stock_gap") > threshold).withColumn("flag", F.lit("Mismatch"))


def with_price_ratio(pricing: DataFrame) -> DataFrame:
    return pricing.withColumn("price_to_sales", safe_ratio(F.col("price"), F.col("sales_volume")))


def price_flags(pricing: DataFrame) -> DataFrame:
    """Over- and underpriced rows with their ratio and ``status``."""
    require(pricing, ["price", "sales_volume"], "pricing")
    return with_price_ratio(pricing).withColumn("status", price_status(F.col("price_to_sales"))).where("status is not null")


def overpriced(pricing: DataFrame) -> DataFrame:
    return price_flags(pricing).where("status = 'Overpriced'").drop("status")


def underpriced(pricing: DataFrame) -> DataFrame:
    return price_flags(pricing).where("status = 'Underpriced'").drop("status")


def labelled_union(parts: dict[str, DataFrame], label: str = "status") -> DataFrame:
    """Tables stacked under each other with the label they come from."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def sales_impact(pricing: DataFrame, forecast: DataFrame) -> DataFrame:
    """Price change against competitors, sales lift against forecast, and the impact label."""
    pricing, forecast = trim_headings(pricing), trim_headings(forecast)
    rows = match_suffixed(pricing, forecast, ("_pricing", "_forecast"))
    price = F.col("price_pricing" if "price_pricing" in rows.columns else "price")
    return (
        rows.withColumn("price_change_pct", pct_change(price, F.col("competitor_prices")))
        .withColumn("sales_lift_pct", pct_change(F.col("sales_volume"), F.col("predicted_sales_quantity")))
        .withColumn("impact", impact_label(F.col("sales_lift_pct")))
    )
