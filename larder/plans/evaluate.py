"""Forecast quality as one aggregation over actual and predicted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.ratios import safe_ratio

# Machine epsilon used as the floor of the MAPE denominator, coverage shares, holding cost.
EPSILON = 2.220446049250313e-16
COVERAGE = {10: 0.1, 25: 0.25, 50: 0.5, 75: 0.75, 90: 0.9}
HOLDING_COST = 0.2


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    error = predicted - actual
    return {
        "mae": F.avg(F.abs(error)),
        "mape": F.avg(F.abs(error) / F.greatest(F.abs(actual), F.lit(EPSILON))),
        "wmape": safe_ratio(F.sum(F.abs(error)), F.sum(actual)),
        "bias": F.avg(error),
    }


def coverage_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """Share of actual values inside predicted * (1 -+ q)."""
    return {
        f"coverage_{pct}": F.avg(
            ((actual >= predicted * F.lit(1 - q)) & (actual <= predicted * F.lit(1 + q))).cast("double")
        )
        for pct, q in COVERAGE.items()
    }


def high_value_metrics(actual: Column, predicted: Column, high_value: Column) -> dict[str, Column]:
    error = F.when(high_value == 1, F.abs(predicted - actual))
    return {
        "high_value_mae": F.avg(error),
        "high_value_wmape": safe_ratio(F.sum(error), F.sum(F.when(high_value == 1, actual))),
    }


def business_metrics(actual: Column, predicted: Column, unit_price: Column) -> dict[str, Column]:
    loss = F.sum(F.greatest(actual - predicted, F.lit(0.0)) * unit_price)
    over = F.greatest(predicted - actual, F.lit(0.0)) * unit_price
    excess, cost = F.sum(over), F.sum(over * F.lit(HOLDING_COST))
    return {
        "revenue_loss": loss,
        "revenue_excess": excess,
        "excess_inventory_cost": cost,
        "total_business_impact": loss + excess + cost,
    }


def evaluate(scored: DataFrame, actual: str = "sales_quantity", predicted: str = "prediction") -> DataFrame:
    """One row of metrics; high-value and business metrics when their columns are there."""
    rows = scored.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    metrics = {**error_metrics(y, p), **coverage_metrics(y, p)}
    if "is_high_value" in scored.columns:
        metrics |= high_value_metrics(y, p, F.col("is_high_value"))
    if "unit_price" in scored.columns:
        metrics |= business_metrics(y, p, F.col("unit_price"))
    return rows.agg(*[c.alias(name) for name, c in metrics.items()])
