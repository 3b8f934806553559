"""Ratios that stay defined when the denominator is zero, and what builds on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """n/d in doubles; signed infinity for n/0 and null for 0/0."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(
        d == 0, F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF))
    ).otherwise(F.try_divide(n, d))


def pct_change(value: Column, base: Column) -> Column:
    """Change against a base in percent."""
    return safe_ratio(value - base, base) * F.lit(100.0)


def impact_label(lift_pct: Column, cut: float = 10.0) -> Column:
    """Effective above +cut, Ineffective below -cut, Neutral otherwise (also for null)."""
    return (
        F.when(lift_pct > cut, "Effective")
        .when(lift_pct < -cut, "Ineffective")
        .otherwise("Neutral")
    )


def price_status(ratio: Column, over: float = 1.5, under: float = 0.5) -> Column:
    """Overpriced / Underpriced by strict bounds, null in between."""
    return F.when(ratio > over, "Overpriced").when(ratio < under, "Underpriced")


def blend(parts: dict[str, float]) -> Column:
    """Weighted sum of prediction columns, added in the order given."""
    total = None
    for name, weight in parts.items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total
