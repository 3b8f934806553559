"""Queries over the demand series: calendar, encodings, windows, splits, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query, rounded
from larder.functions.calendar import date_parts, holiday_dimension, us_holiday
from larder.functions.encoders import factor_flags, one_hot
from larder.functions.ratios import blend
from larder.operators.columns import parse_date, with_defaults
from larder.operators.matching import with_holidays
from larder.operators.positions import chronological_holdout, expanding_folds, with_positions
from larder.operators.quantiles import exact_quantiles
from larder.operators.summaries import daily_total, level_list, top_n
from larder.operators.windows import naive_forecast, over_series, lag_columns, rolling_mean, seasonal_decomposition
from larder.plans import evaluate, features, forecast, reports
from larder.schemas import KEYS
from larder.session import stage

K = "product_id, store_id, cast(dt as varchar) as date"
W = "partition by product_id, store_id order by dt"
KEY = [*KEYS, "date"]


@query("daily_demand", "A01", "select cast(dt as varchar) as date, sum(sales_quantity) as sales_quantity from demand group by dt", "demand")
def _(v):
    return daily_total(v.demand)


@query(
    "defaulted_columns",
    "P07",
    f"select {K}, 0 as promotion_budget, 0 as promotion_days, 100 as weather_index, 100 as economic_index, demand_trend, seasonality_factors from demand",
    "demand",
)
def _(v):
    rows = with_defaults(v.demand)
    return rows.select(*KEY, "promotion_budget", "promotion_days", "weather_index", "economic_index", "demand_trend", "seasonality_factors")


@query(
    "parsed_dates",
    "P06",
    """select l_linenumber, count(*) as parsed from (
         select l_linenumber, try_cast(case when l_linenumber % 3 = 0 then 'n/a' else cast(cast(l_shipdate as date) as varchar) end as date) as d from lineitem)
       where d is not null group by 1""",
)
def _(v):
    text = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.to_date("l_shipdate").cast("string"))
    rows = v.table("lineitem").select("l_linenumber", parse_date(text).alias("d"))
    return rows.where("d is not null").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("parsed"))


@query(
    "calendar_parts",
    "E10 E11",
    f"""select {K}, (isodow(dt) - 1)::int as day_of_week, day(dt)::int as day_of_month, month(dt)::int as month, year(dt)::int as year,
               case when isodow(dt) >= 6 then 1 else 0 end as is_weekend from demand""",
    "demand",
)
def _(v):
    return v.demand.select(*KEY).withColumns(date_parts(F.col("date")))


@query(
    "holiday_flags",
    "E12",
    f"select {K}, case when holiday is null then 0 else 1 end as is_holiday, holiday from demand left join holidays using (dt)",
    "demand holidays",
)
def _(v):
    rows = features.with_calendar(v.demand).select(*KEY, "is_holiday")
    return rows.withColumn("holiday", us_holiday(F.col("date")))


@query("holiday_join", "J10", f"select {K}, holiday from demand left join holidays using (dt)", "demand holidays")
def _(v):
    return with_holidays(v.demand.select(*KEY), holiday_dimension(v.spark, 1990, 2030))


@query(
    "demand_on_holidays",
    "J10 A01",
    "select holiday, count(*) as days, sum(sales_quantity) as sales_quantity from demand join holidays using (dt) group by 1",
    "demand holidays",
)
def _(v):
    rows = with_holidays(v.demand, holiday_dimension(v.spark, 1990, 2030)).where("holiday is not null")
    return rows.groupBy("holiday").agg(F.count(F.lit(1)).alias("days"), F.sum("sales_quantity").alias("sales_quantity"))


CODES = """case promotions when 'Yes' then 1 when 'No' then 0 end as promotions_code,
           case seasonality_factors when 'Festival' then 2 when 'Holiday' then 1 when 'None' then 0 end as seasonality_code,
           case demand_trend when 'Increasing' then 1 when 'Stable' then 0 when 'Decreasing' then -1 end as trend_code"""


@query("label_codes", "E13 J09", f"select {K}, {CODES} from demand", "demand")
def _(v):
    return features.with_codes(v.demand).select(*KEY, *features.CODES)


@query(
    "label_codes_filled",
    "E13",
    f"select {K}, case demand_trend when 'Increasing' then 1 else 0 end as trend_code from (select * replace (case when demand_trend = 'Decreasing' then 'Falling' else demand_trend end as demand_trend) from demand)",
    "demand",
)
def _(v):
    renamed = F.when(F.col("demand_trend") == "Decreasing", "Falling").otherwise(F.col("demand_trend"))
    return features.with_codes(v.demand.withColumn("demand_trend", renamed), fill=0).select(*KEY, "trend_code")


FLAGS = """case when contains(external_factors, 'Competitor') then 1 else 0 end as has_competitor,
           case when contains(external_factors, 'Weather') then 1 else 0 end as bad_weather,
           case when contains(external_factors, 'Economic') then 1 else 0 end as economic_downturn"""


@query("factor_flags", "E14", f"select {K}, {FLAGS} from demand", "demand")
def _(v):
    return v.demand.withColumns(factor_flags(v.demand.columns)).select(*KEY, *features.FLAGS)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _segments(names: list[str], prefix: str = "segment_") -> str:
    return ", ".join(f"case when customer_segments = '{n}' then 1 else 0 end as {prefix}{n.lower()}" for n in names)


@query("segment_columns", "E15", f"select {K}, {_segments(SEGMENTS)} from demand", "demand")
def _(v):
    return v.demand.withColumns(one_hot("customer_segments", _levels(v))).select(*KEY, *[f"segment_{s.lower()}" for s in SEGMENTS])


@query("segment_columns_drop_first", "E15", f"select {K}, {_segments(SEGMENTS[1:], 'is_')} from demand", "demand")
def _(v):
    rows = v.demand.withColumns(one_hot("customer_segments", _levels(v), prefix="is_", drop_first=True))
    return rows.select(*KEY, *[f"is_{s.lower()}" for s in SEGMENTS[1:]])


def _levels(v):
    """Segment levels, fitted on the table the demand's segments come from."""
    return level_list(v.table("customer").withColumnRenamed("c_mktsegment", "customer_segments"), "customer_segments")


EFFECTS = """promotion_budget / max(promotion_budget) over () as promo_intensity, promotion_days * 0.1::double as promo_duration_effect,
             weather_index * 0.05::double as weather_impact, (economic_index - 100) * 0.1::double as economic_impact"""


@query("external_effects", "E16 A05", f"select {K}, {EFFECTS} from demand_indexed", "demand_indexed")
def _(v):
    rows = features.with_effects(v.demand_indexed)
    return rows.select(*KEY, "promo_intensity", "promo_duration_effect", "weather_impact", "economic_impact")


CUT = "cut as (select quantile_cont(unit_price, 0.8) as q from demand)"


@query("price_quantiles", "A04", "select round(quantile_cont(unit_price, 0.75), 6) as q75, round(quantile_cont(unit_price, 0.8), 6) as q80, round(quantile_cont(unit_price, 0.5), 6) as q50 from demand", "demand")
def _(v):
    q = exact_quantiles(v.demand, "unit_price", [0.75, 0.8, 0.5])
    row = [(q[0.75], q[0.8], q[0.5])]
    return rounded(v.spark.createDataFrame(row, "q75 double, q80 double, q50 double"), "q75", "q80", "q50")


@query("high_value_flags", "E18 A04", f", {CUT} select {K}, case when unit_price > q then 1 else 0 end as is_high_value from demand, cut", "demand")
def _(v):
    return features.with_high_value(v.demand, features.high_value_cut(v.demand)).select(*KEY, "is_high_value")


@query(
    "interaction_terms",
    "E17",
    f""", {CUT} select {K}, case promotions when 'Yes' then 1 else 0 end * case seasonality_factors when 'Festival' then 2 when 'Holiday' then 1 else 0 end as promo_season_interaction,
              case when unit_price > q then 1 else 0 end * (weather_index * 0.05::double) as value_weather_interaction from demand_indexed, cut""",
    "demand demand_indexed",
)
def _(v):
    rows = features.with_high_value(features.with_effects(v.demand_indexed), features.high_value_cut(v.demand))
    rows = features.with_interactions(features.with_codes(rows))
    return rows.select(*KEY, "promo_season_interaction", "value_weather_interaction")


# --- windows ---


@query(
    "lags",
    "W01",
    f"""select {K}, lag(sales_quantity, 1) over w as lag_1, lag(sales_quantity, 7) over w as lag_7, lag(sales_quantity, 30) over w as lag_30
        from demand window w as ({W})""",
    "demand",
)
def _(v):
    rows = v.demand.select(*KEY, "sales_quantity")
    return over_series(rows, KEYS, ["date"], lag_columns("sales_quantity", [1, 7, 30]), 30, daily_grain=True).drop("sales_quantity")


def _mean(n: int, frame: str) -> str:
    over = f"over ({W} rows between {frame})"
    return f"case when count(*) {over} = {n} then avg(sales_quantity) {over} end"


@query(
    "rolling_means",
    "W02",
    f"select {K}, {_mean(7, '6 preceding and current row')} as rolling_7_mean, {_mean(30, '29 preceding and current row')} as rolling_30_mean from demand",
    "demand",
)
def _(v):
    rows = v.demand.select(*KEY, "sales_quantity")
    columns = lambda w: {f"rolling_{n}_mean": rolling_mean("sales_quantity", n, w) for n in (7, 30)}
    return over_series(rows, KEYS, ["date"], columns, 30, daily_grain=True).drop("sales_quantity")


@query(
    "rolling_means_long_series",
    "W01 W02",
    f"""select {K}, {_mean(7, '6 preceding and current row')} as rolling_7_mean, lag(sales_quantity, 7) over ({W}) as lag_7
        from (select 'all' as product_id, 'all' as store_id, dt, sum(sales_quantity) as sales_quantity from demand group by dt)""",
    "demand",
)
def _(v):
    total = daily_total(v.demand).withColumns({k: F.lit("all") for k in KEYS})

    def columns(w):
        return {"rolling_7_mean": rolling_mean("sales_quantity", 7, w), "lag_7": F.lag("sales_quantity", 7).over(w)}

    # one series holds the whole table: cut into blocks of 100 rows
    return over_series(total, KEYS, ["date"], columns, 7, block_rows=100).drop("sales_quantity")


@query(
    "rolling_means_shifted",
    "W02",
    f"select {K}, {_mean(7, '7 preceding and 1 preceding')} as rolling_7_mean from demand",
    "demand",
)
def _(v):
    rows = v.demand.select(*KEY, "sales_quantity")
    columns = lambda w: {"rolling_7_mean": rolling_mean("sales_quantity", 7, w, shifted=True)}
    return over_series(rows, KEYS, ["date"], columns, 7, daily_grain=True).drop("sales_quantity")


@query("naive_forecast", "W03 M13", f"select {K}, prediction as predicted_demand from scored", "scored")
def _(v):
    return naive_forecast(v.demand, KEYS, ["date"], daily_grain=True).select(*KEY, "predicted_demand")


@query(
    "seasonal_decomposition",
    "W04",
    f""", n as (select *, (row_number() over ({W}) - 1) % 7 as phase, count(*) over (partition by product_id, store_id) as len,
                      case when count(*) over ({W} rows between 3 preceding and 3 following) = 7
                           then sum(sales_quantity) over ({W} rows between 3 preceding and 3 following) / 7 end as tr from demand),
          m as (select product_id, store_id, phase, avg(sales_quantity - tr) as mean from n group by all),
          s as (select product_id, store_id, phase, mean - avg(mean) over (partition by product_id, store_id) as seas from m)
        select {K}, sales_quantity, round(case when len >= 14 then tr end, 6) + 0.0::double as trend, round(case when len >= 14 then seas end, 6) + 0.0::double as seasonal,
               round(case when len >= 14 then sales_quantity - tr - seas end, 6) + 0.0::double as residual
        from n join s using (product_id, store_id, phase)""",
    "demand",
)
def _(v):
    rows = seasonal_decomposition(v.demand.select(*KEY, "sales_quantity"), KEYS, ["date"], daily_grain=True)
    return rounded(rows, "trend", "seasonal", "residual")


NUMBERED = "numbered as (select *, row_number() over (order by dt, product_id, store_id) - 1 as position, count(*) over () as n from demand)"


@query(
    "chronological_holdout",
    "W05 L05",
    f", {NUMBERED} select {K}, sales_quantity, position, position >= n - cast(trunc(n * 0.2::double) as bigint) as is_test from numbered",
    "demand",
)
def _(v):
    return chronological_holdout(v.demand.select(*KEY, "sales_quantity"), forecast.ORDER)


@query(
    "expanding_folds",
    "W06",
    f""", {NUMBERED} select {K}, position,
          case when position < n - (n // 6) * 5 then 0 else cast((position - (n - (n // 6) * 5)) // (n // 6) + 1 as integer) end as fold from numbered""",
    "demand",
)
def _(v):
    return expanding_folds(v.demand.select(*KEY), forecast.ORDER)


@query(
    "ranked_predictions",
    "L02 L03",
    f"select {K}, prediction from scored order by prediction desc, dt, product_id, store_id limit 100",
    "scored",
)
def _(v):
    return top_n(v.scored.select(*KEY, "prediction"), [F.desc("prediction"), *map(F.col, forecast.ORDER)], 100)


@query(
    "sorted_predictions",
    "L02",
    f"select {K}, prediction, row_number() over (order by prediction desc, dt, product_id, store_id) - 1 as position from scored",
    "scored",
)
def _(v):
    """The full order, as positions."""
    rows = v.scored.select(*KEY, "prediction", (-F.col("prediction")).alias("_down"))
    return with_positions(rows, ["_down", *forecast.ORDER]).drop("_down")


@query(
    "series_with_equal_dates",
    "W01 W02",
    """select product_id, dt::varchar as date, sales_quantity, n - 1 as row, lag(sales_quantity, 1) over (partition by product_id order by n) as lag_1
       from (select product_id, date_trunc('month', dt)::date as dt, sales_quantity,
               row_number() over (partition by product_id order by date_trunc('month', dt), sales_quantity, store_id, dt) as n from demand)""",
    "demand",
)
def _(v):
    """Long series by product whose months repeat: blocks, with a full order given."""
    rows = v.demand.select("product_id", F.trunc("date", "month").alias("month"), "sales_quantity", "store_id", "date")
    order = ["month", "sales_quantity", "store_id", "date"]
    out = over_series(rows, ["product_id"], order, lambda w: {"row": F.col("_row"), "lag_1": F.lag("sales_quantity", 1).over(w)}, 1, block_rows=500)
    return out.select("product_id", F.col("month").alias("date"), "sales_quantity", "row", "lag_1")


@query(
    "high_demand_flags",
    "E19 A04 L02",
    f", cut as (select quantile_cont(prediction, 0.75) as q from scored) select {K}, prediction, prediction > q as high_demand from scored, cut",
    "scored",
)
def _(v):
    return forecast.with_high_demand(v.scored.select(*KEY, "prediction"), "prediction")


@query("prediction_bounds", "E20", f"select {K}, prediction * 0.9::double as pred_lower, prediction * 1.1::double as pred_upper from scored", "scored")
def _(v):
    return reports.with_bounds(v.scored).select(*KEY, "pred_lower", "pred_upper")


PARTS = "prediction as trend_prediction, sales_quantity + 1 as boosted_prediction, prediction / 2 as leafwise_prediction"


@query(
    "blended_predictions",
    "E21 E20",
    f"select {K}, trend_prediction * 0.4::double + boosted_prediction * 0.3::double + leafwise_prediction * 0.3::double as blended from (select *, {PARTS} from scored)",
    "scored",
)
def _(v):
    rows = v.scored.withColumns(
        {
            "trend_prediction": F.col("prediction"),
            "boosted_prediction": F.col("sales_quantity") + 1,
            "leafwise_prediction": F.col("prediction") / 2,
        }
    )
    return rows.select(*KEY, blend(forecast.BLEND).alias("blended"))


@query(
    "forecast_lines",
    "B14 L05",
    f"select {K}, sales_quantity as actual, prediction, prediction * 0.9::double as pred_lower, prediction * 1.1::double as pred_upper from scored",
    "scored",
)
def _(v):
    return reports.forecast_lines(reports.with_bounds(v.scored))


@query(
    "interval_band",
    "U03",
    f""", b as (select *, row_number() over (order by dt, product_id, store_id) - 1 as seq, count(*) over () as n from scored)
        select {K}, prediction * 1.1::double as bound, 'upper' as side, seq from b
        union all select {K}, prediction * 0.9::double, 'lower', 2 * n - 1 - seq from b""",
    "scored",
)
def _(v):
    return reports.interval_band(reports.with_bounds(v.scored))


# --- evaluation ---

Y, P = "sales_quantity", "prediction"
ERRORS = f"""avg(abs({P} - {Y})) as mae, avg(abs({P} - {Y}) / greatest(abs({Y}), 2.220446049250313e-16)) as mape,
             sum(abs({P} - {Y})) / sum({Y}) as wmape, avg({P} - {Y}) as bias"""
COVERAGE = ", ".join(
    f"avg(case when {Y} >= {P} * (1 - {q})::double and {Y} <= {P} * (1 + {q})::double then 1.0::double else 0.0::double end) as coverage_{n}"
    for n, q in {10: 0.1, 25: 0.25, 50: 0.5, 75: 0.75, 90: 0.9}.items()
)
HIGH = f"""avg(abs({P} - {Y})) filter (is_high_value = 1) as high_value_mae,
           sum(abs({P} - {Y})) filter (is_high_value = 1) / sum({Y}) filter (is_high_value = 1) as high_value_wmape"""
BUSINESS = f"""sum(greatest({Y} - {P}, 0) * unit_price) as revenue_loss, sum(greatest({P} - {Y}, 0) * unit_price) as revenue_excess,
               sum(greatest({P} - {Y}, 0) * unit_price * 0.2::double) as excess_inventory_cost,
               sum(greatest({Y} - {P}, 0) * unit_price) + sum(greatest({P} - {Y}, 0) * unit_price) + sum(greatest({P} - {Y}, 0) * unit_price * 0.2::double) as total_business_impact"""
MONEY = ["revenue_loss", "revenue_excess", "excess_inventory_cost", "total_business_impact"]


def _rounded_sql(body: str, names: list[str], digits: int = 6) -> str:
    return "select " + ", ".join(f"round({n}, {digits}) as {n}" for n in names) + f" from ({body})"


ERROR_NAMES = ["mae", "mape", "wmape", "bias"]
COVERAGE_NAMES = ["coverage_10", "coverage_25", "coverage_50", "coverage_75", "coverage_90"]
HIGH_NAMES = ["high_value_mae", "high_value_wmape"]


@query("error_metrics", "A06", _rounded_sql(f"select {ERRORS} from scored", ERROR_NAMES), "scored")
def _(v):
    metrics = evaluate.error_metrics(F.col("sales_quantity"), F.col("prediction"))
    return rounded(v.scored.agg(*[c.alias(n) for n, c in metrics.items()]), *ERROR_NAMES)


@query("error_metrics_by_store", "A06", f"select store_id, {', '.join(f'round({n}, 6) as {n}' for n in ERROR_NAMES)} from (select store_id, {ERRORS} from scored group by 1)", "scored")
def _(v):
    metrics = evaluate.error_metrics(F.col("sales_quantity"), F.col("prediction"))
    return rounded(v.scored.groupBy("store_id").agg(*[c.alias(n) for n, c in metrics.items()]), *ERROR_NAMES)


@query("coverage_metrics", "A07", _rounded_sql(f"select {COVERAGE} from scored", COVERAGE_NAMES), "scored")
def _(v):
    metrics = evaluate.coverage_metrics(F.col("sales_quantity"), F.col("prediction"))
    return rounded(v.scored.agg(*[c.alias(n) for n, c in metrics.items()]), *COVERAGE_NAMES)


FLAGGED = f", {CUT}, flagged as (select *, case when unit_price > q then 1 else 0 end as is_high_value from scored, cut)"


@query("high_value_metrics", "A08", f"{FLAGGED} {_rounded_sql(f'select {HIGH} from flagged', HIGH_NAMES)}", "scored")
def _(v):
    rows = features.with_high_value(v.scored, features.high_value_cut(v.demand))
    metrics = evaluate.high_value_metrics(F.col("sales_quantity"), F.col("prediction"), F.col("is_high_value"))
    return rounded(rows.agg(*[c.alias(n) for n, c in metrics.items()]), *HIGH_NAMES)


@query("business_metrics", "A09", _rounded_sql(f"select {BUSINESS} from scored", MONEY, 2), "scored")
def _(v):
    metrics = evaluate.business_metrics(F.col("sales_quantity"), F.col("prediction"), F.col("unit_price"))
    return rounded(v.scored.agg(*[c.alias(n) for n, c in metrics.items()]), *MONEY, digits=2)


ALL_NAMES = [*ERROR_NAMES, *COVERAGE_NAMES, *HIGH_NAMES]


@query(
    "evaluation",
    "M09 A06 A07 A08 A09",
    f"{FLAGGED} select "
    + ", ".join([*[f"round({n}, 6) as {n}" for n in ALL_NAMES], *[f"round({n}, 2) as {n}" for n in MONEY]])
    + f" from (select {ERRORS}, {COVERAGE}, {HIGH}, {BUSINESS} from flagged)",
    "scored",
)
def _(v):
    scored = stage(v.scored.select(*KEYS, "sales_quantity", "prediction", "unit_price"), "scored")
    rows = features.with_high_value(scored, features.high_value_cut(scored))
    return rounded(rounded(evaluate.evaluate(rows), *ALL_NAMES), *MONEY, digits=2)


# --- feature tables ---

CAL = """(isodow(dt) - 1)::int as day_of_week, day(dt)::int as day_of_month, month(dt)::int as month, year(dt)::int as year,
         case when isodow(dt) >= 6 then 1 else 0 end as is_weekend"""


@query(
    "demand_features",
    "M06 F11 E10 E11 E12 E13 E14 E15 E16 E17 E18 W01 W02 P04",
    f""", {CUT}, x as (
        select {K}, sales_quantity, unit_price, promotion_budget, promotion_days, weather_index, economic_index,
               case when unit_price > q then 1 else 0 end as is_high_value,
               lag(sales_quantity, 1) over ({W}) as lag_1, lag(sales_quantity, 7) over ({W}) as lag_7, lag(sales_quantity, 30) over ({W}) as lag_30,
               {_mean(7, '6 preceding and current row')} as rolling_7_mean, {_mean(30, '29 preceding and current row')} as rolling_30_mean,
               {CAL}, case when holiday is null then 0 else 1 end as is_holiday, {CODES}, {EFFECTS}, {FLAGS}, {_segments(SEGMENTS)}
        from demand_indexed left join holidays using (dt), cut)
      select *, promotions_code * seasonality_code as promo_season_interaction, is_high_value * weather_impact as value_weather_interaction
      from x where lag_30 is not null and rolling_30_mean is not null""",
    "demand demand_indexed holidays",
)
def _(v):
    # read three times: for the price cut, the largest budget and the features
    rows = stage(v.demand_indexed, "demand")
    return features.demand_features(rows, levels=_levels(v), daily_grain=True)


@query(
    "flat_features",
    "M06 E13 E14 E15",
    f"""select {K}, sales_quantity, unit_price, (isodow(dt) - 1)::int as day_of_week, day(dt)::int as day_of_month, month(dt)::int as month, year(dt)::int as year,
               {CODES}, {FLAGS}, {_segments(SEGMENTS)} from demand""",
    "demand",
)
def _(v):
    return features.flat_features(v.demand, _levels(v))


@query(
    "request_features",
    "M06 E13 E15",
    f"""select {K}, sales_quantity, unit_price, promotions, seasonality_factors, demand_trend, customer_segments, external_factors, {CODES}, {_segments(SEGMENTS[1:])} from demand""",
    "demand",
)
def _(v):
    return features.request_features(v.demand, _levels(v))
