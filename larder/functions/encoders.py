"""Encodings of the demand table's categorical columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label codes.
PROMOTION_CODES = {"Yes": 1, "No": 0}
SEASON_CODES = {"Festival": 2, "Holiday": 1, "None": 0}
TREND_CODES = {"Increasing": 1, "Stable": 0, "Decreasing": -1}
FACTOR_WORDS = {"has_competitor": "Competitor", "bad_weather": "Weather", "economic_downturn": "Economic"}


def coded(column: Column, codes: dict[str, int], fill: int | None = None) -> Column:
    """Integer code of a label; unknown labels give null, or ``fill``."""
    out = None
    for label, code in codes.items():
        out = F.when(column == label, code) if out is None else out.when(column == label, code)
    return out if fill is None else out.otherwise(fill)


def mentions(column: Column, word: str) -> Column:
    """1 when the text holds the word, 0 otherwise and for null."""
    return F.coalesce(column.contains(word), F.lit(False)).cast("int")


def factor_flags(columns: list[str]) -> dict[str, Column]:
    if "external_factors" not in columns:
        return {name: F.lit(0) for name in FACTOR_WORDS}
    return {name: mentions(F.col("external_factors"), word) for name, word in FACTOR_WORDS.items()}


def slug(level: str) -> str:
    return "".join(c.lower() if c.isalnum() else "_" for c in level)


def one_hot(column: str, levels: list[str], prefix: str = "segment_", drop_first: bool = False) -> dict[str, Column]:
    """0/1 column per level, levels in alphabetical order; null gives all zeros."""
    kept = sorted(levels)[1 if drop_first else 0 :]
    return {
        f"{prefix}{slug(level)}": F.coalesce((F.col(column) == level).cast("int"), F.lit(0)) for level in kept
    }


def external_effects(columns: list[str]) -> dict[str, Column]:
    """Scaled promotion, weather and economy effects for the columns that exist."""
    out: dict[str, Column] = {}
    if "promotion_days" in columns:
        out["promo_duration_effect"] = F.col("promotion_days") * F.lit(0.1)
    if "weather_index" in columns:
        out["weather_impact"] = F.col("weather_index") * F.lit(0.05)
    if "economic_index" in columns:
        out["economic_impact"] = (F.col("economic_index") - 100) * F.lit(0.1)
    return out
