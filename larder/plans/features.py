"""Feature tables for demand models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.calendar import date_parts, is_us_holiday
from larder.functions.encoders import (
    PROMOTION_CODES,
    SEASON_CODES,
    TREND_CODES,
    coded,
    external_effects,
    factor_flags,
    one_hot,
)
from larder.operators.columns import drop_incomplete, parse_date
from larder.operators.quantiles import exact_quantiles
from larder.operators.summaries import level_list
from larder.operators.windows import BLOCK_ROWS, with_history
from larder.schemas import KEYS

HIGH_VALUE_SHARE = 0.8
CALENDAR = ["day_of_week", "day_of_month", "month", "year", "is_weekend", "is_holiday"]
CODES = ["promotions_code", "seasonality_code", "trend_code"]
FLAGS = ["has_competitor", "bad_weather", "economic_downturn"]
LABELS = ["promotions", "seasonality_factors", "external_factors", "demand_trend", "customer_segments"]
HISTORY = ["lag_1", "lag_7", "lag_30", "rolling_7_mean", "rolling_30_mean"]


def with_calendar(demand: DataFrame, holidays: bool = True) -> DataFrame:
    day = F.col("date")
    parts = date_parts(day)
    if holidays:
        parts["is_holiday"] = is_us_holiday(day)
    return demand.withColumns(parts)


def with_codes(demand: DataFrame, fill: int | None = None) -> DataFrame:
    """Label codes next to the labels; a missing seasonality column counts as 0."""
    season = coded(F.col("seasonality_factors"), SEASON_CODES, fill) if "seasonality_factors" in demand.columns else F.lit(0)
    return demand.withColumns(
        {
            "promotions_code": coded(F.col("promotions"), PROMOTION_CODES, fill),
            "seasonality_code": season,
            "trend_code": coded(F.col("demand_trend"), TREND_CODES, fill),
        }
    )


def with_effects(demand: DataFrame) -> DataFrame:
    """External effects and promotion intensity against the largest budget of the table."""
    out = demand.withColumns(external_effects(demand.columns))
    if "promotion_budget" in demand.columns:
        largest = demand.agg(F.max("promotion_budget").cast("double")).scalar()
        out = out.withColumn("_largest", largest)
        # no budget anywhere means no promotion: 0, not 0/0
        out = out.withColumn(
            "promo_intensity",
            F.when(F.col("_largest") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("promotion_budget").cast("double"), F.col("_largest"))),
        ).drop("_largest")
    return out


def high_value_cut(demand: DataFrame, share: float = HIGH_VALUE_SHARE) -> float | None:
    return exact_quantiles(demand, "unit_price", [share])[share]


def with_high_value(demand: DataFrame, cut: float | None) -> DataFrame:
    above = F.col("unit_price") > F.lit(cut) if cut is not None else F.lit(False)
    return demand.withColumn("is_high_value", F.coalesce(above, F.lit(False)).cast("int"))


def with_interactions(demand: DataFrame) -> DataFrame:
    """Products of encoded columns, so after the encodings."""
    out = demand.withColumn("promo_season_interaction", F.col("promotions_code") * F.col("seasonality_code"))
    if "is_high_value" in out.columns and "weather_impact" in out.columns:
        out = out.withColumn("value_weather_interaction", F.col("is_high_value") * F.col("weather_impact"))
    return out


def demand_features(
    demand: DataFrame,
    levels: list[str] | None = None,
    cut: float | None = None,
    shifted: bool = False,
    daily_grain: bool = False,
    keep_incomplete: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Calendar, codes, flags, segments, interactions, lags and rolling means of a demand table.

    ``levels`` (segments) and ``cut`` (high-value price) are fitted on the table when
    not given; pass the fitted ones when scoring. Rows with a null feature are dropped
    unless ``keep_incomplete``.
    """
    if "unit_price" in demand.columns and cut is None:
        cut = high_value_cut(demand)
    levels = level_list(demand, "customer_segments") if levels is None else levels
    rows = with_effects(demand)
    if "unit_price" in demand.columns:
        rows = with_high_value(rows, cut)
    rows = with_codes(rows).withColumns(factor_flags(demand.columns)).withColumns(one_hot("customer_segments", levels))
    rows = with_interactions(rows.withColumn("date", parse_date(F.col("date")))).drop(*LABELS)
    rows = with_history(rows, KEYS, ["date"], "sales_quantity", shifted=shifted, daily_grain=daily_grain, block_rows=block_rows)
    if not keep_incomplete:
        # every other feature is null only where one of these is
        kept = [c for c in demand.columns if c not in LABELS]
        rows = drop_incomplete(rows, [*kept, *CODES, *HISTORY])
    return with_calendar(rows)


def flat_features(demand: DataFrame, levels: list[str]) -> DataFrame:
    """The features of the single boosted model: calendar, codes with 0 for unknown labels,
    factor flags and unprefixed segments; no history."""
    rows = with_codes(with_calendar(demand, holidays=False).drop("is_weekend"), fill=0)
    return (
        rows.withColumns(factor_flags(demand.columns))
        .withColumns(one_hot("customer_segments", levels))
        .drop(*LABELS)
    )


def request_features(demand: DataFrame, levels: list[str]) -> DataFrame:
    """The codes of a prediction request: null for unknown labels, first segment dropped."""
    return with_codes(demand.withColumn("date", parse_date(F.col("date")))).withColumns(
        one_hot("customer_segments", levels, drop_first=True)
    )
