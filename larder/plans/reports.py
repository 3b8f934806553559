"""Tables that feed charts, named projections, and the text digest of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import intent
from larder.operators.positions import with_positions
from larder.operators.summaries import top_n
from larder.schemas import KEYS

DIGEST_ROWS = 5


def stock_bars(inventory: DataFrame, n: int = 20) -> DataFrame:
    """Stock against reorder point for the first n products."""
    order = [F.col("product_id"), F.col("store_id")]
    return top_n(inventory.select(*KEYS, "stock_levels", "reorder_point"), order, n)


def price_points(pricing: DataFrame, before: str = "price", after: str = "competitor_prices") -> DataFrame:
    return pricing.select(*KEYS, F.col(before).alias("price_before"), F.col(after).alias("price_after"), "sales_volume")


def stock_trend(rows: DataFrame, date: str = "date") -> DataFrame:
    return rows.select(F.col(date).alias("date"), "product_id", "stock_levels")


def forecast_lines(scored: DataFrame, actual: str = "sales_quantity") -> DataFrame:
    """Actual, forecast and bounds per date, in date order."""
    return scored.select("date", *KEYS, F.col(actual).alias("actual"), "prediction", "pred_lower", "pred_upper").orderBy(
        "date", *KEYS
    )


def with_bounds(scored: DataFrame, prediction: str = "prediction", share: float = 0.1) -> DataFrame:
    return scored.withColumns(
        {"pred_lower": F.col(prediction) * F.lit(1 - share), "pred_upper": F.col(prediction) * F.lit(1 + share)}
    )


def interval_band(scored: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Outline of the forecast interval: upper bounds in date order, then lower bounds backwards.

    ``seq`` numbers the points of the outline from 0.
    """
    order_by = order_by or ["date", *KEYS]
    rows = with_positions(scored.select(*order_by, "pred_lower", "pred_upper"), order_by, "seq")
    last = rows.agg((F.count(F.lit(1)) * 2 - 1).alias("x")).scalar()
    upper = rows.select(*order_by, F.col("pred_upper").alias("bound"), F.lit("upper").alias("side"), "seq")
    lower = rows.select(
        *order_by, F.col("pred_lower").alias("bound"), F.lit("lower").alias("side"), (last - F.col("seq")).alias("seq")
    )
    return upper.unionByName(lower)


# Columns of the three named projections.
PROJECTIONS = {
    "inventory": ["product_id", "stock_levels"],
    "forecast": ["product_id", "prediction", "pred_lower", "pred_upper"],
    "pricing": ["product_id", "price", "competitor_prices"],
}


def projection(df: DataFrame, name: str) -> DataFrame:
    return df.select(*PROJECTIONS[name])


def filter_reports(df: DataFrame, product: str | None = None, store: str | None = None) -> DataFrame:
    """Rows whose product and store id contain the patterns; an empty pattern keeps all."""
    from larder.operators.matching import product_filter

    return product_filter(product_filter(df, product, "product_id"), store, "store_id")


def intents(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumn("intent", intent(F.col(column)))


def intent_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    return intents(texts, column).groupBy("intent").agg(F.count(F.lit(1)).alias("texts"))


def _record(columns: list[str]) -> Column:
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws(", ", *pairs)


def digest(sections: dict[str, tuple[DataFrame, list[str]]], n: int = DIGEST_ROWS) -> DataFrame:
    """(section, digest): the first n rows of each report as numbered lines under a title.

    ``sections`` gives each report and the columns that order it. A report is cut to
    its first n rows by a distributed top-k before its lines are put together.
    """
    out = None
    for name, (df, order) in sections.items():
        rows = top_n(df, [F.col(c) for c in order], n).select(*order, _record(df.columns).alias("_record"))
        lines = rows.agg(F.array_sort(F.collect_list(F.struct(*order, "_record"))).alias("rows"))
        numbered = F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["_record"]))
        text = F.concat(F.lit(f"### {name} ###\n"), F.array_join(numbered, "\n"))
        block = lines.select(F.lit(name).alias("section"), text.alias("digest"))
        out = block if out is None else out.unionByName(block)
    return out
