"""Column clean-up: headings, types, defaults, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.schemas import HEADINGS, KEYS

# What a demand table without these columns is taken to hold.
DEMAND_DEFAULTS = {
    "promotion_budget": 0,
    "promotion_days": 0,
    "weather_index": 100,
    "economic_index": 100,
    "seasonality_factors": "None",
    "demand_trend": "Stable",
}


def trim_headings(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def standard_names(df: DataFrame, headings: dict[str, str] = HEADINGS) -> DataFrame:
    """Trim headings and rename the known ones to snake_case."""
    trimmed = trim_headings(df)
    return trimmed.withColumnsRenamed({c: headings[c] for c in trimmed.columns if c in headings})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above every number, so it is turned to null on the way in."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def parse_date(column: Column, strict: bool = False) -> Column:
    """Text to date; an unreadable date is null, or an error when ``strict``."""
    return column.cast("date") if strict else column.try_cast("date")


def with_defaults(df: DataFrame, defaults: dict[str, object] = DEMAND_DEFAULTS) -> DataFrame:
    """Add the columns that are missing, with their default value."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def align_keys(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Make the join keys of both sides comparable: text on both where types differ."""
    for key in keys:
        if left.schema[key].dataType != right.schema[key].dataType:
            left = left.withColumn(key, F.col(key).cast("string"))
            right = right.withColumn(key, F.col(key).cast("string"))
    return left, right


def backfill_store(forecast: DataFrame, inventory: DataFrame, default: str = "DEFAULT_STORE", first: bool = False) -> DataFrame:
    """Give a forecast without ``store_id`` one: the only store there is, else ``default``.

    ``first`` takes the lowest store id instead, however many there are.
    """
    if "store_id" in forecast.columns:
        return forecast
    store = F.min(F.col("store_id").cast("string"))
    if not first:
        store = F.when(F.count_distinct("store_id") == 1, store).otherwise(default)
    return forecast.withColumn("store_id", inventory.agg(store.alias("s")).scalar())


def stamped(as_of: str) -> Column:
    """Run time as text; always a parameter, so that a rerun gives the same table."""
    return F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def tag(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return df.na.drop("any", subset=columns)


def attach_predictions(rows: DataFrame, predictions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Put predictions next to the rows they belong to; a repeated key on the prediction side is an error."""
    once = predictions.groupBy(*keys).agg(
        *[
            F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate prediction key"))).otherwise(F.first(c)).alias(c)
            for c in predictions.columns
            if c not in keys
        ]
    )
    rows, once = align_keys(rows, once, keys)
    return rows.join(once, keys, "inner")


def normal_forecast(df: DataFrame) -> DataFrame:
    """Bring any of the three forecast shapes to product, store, date?, predicted_demand, bounds?."""
    from larder.functions.stock import picked_demand

    if "prediction" in df.columns and "predicted_demand" not in df.columns:
        df = df.withColumnRenamed("prediction", "predicted_demand")
    kept = [c for c in ("product_id", "store_id", "date") if c in df.columns]
    bounds = [F.col(c).cast("double") for c in ("pred_lower", "pred_upper") if c in df.columns]
    return df.select(*kept, picked_demand(df.columns).alias("predicted_demand"), *bounds)
