"""Queries that fit models, and what of them SQL can say: keys, identities, dates, names.

The boosted models are trained with the setting ``CHECKED`` (see README): a higher rate and fewer rounds than
the library's defaults, under the same stop rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query, rounded
from checks.demand_queries import K, W
from larder.operators.summaries import level_list
from larder.plans import boosting, features, forecast
from larder.session import stage

CHECKED = forecast.Boosting(rounds=8, patience=2, rate=0.3, depth=4)
CHECKED_LEAFWISE = forecast.Boosting(rounds=8, patience=2, rate=0.3, depth=None, leaves=31, min_leaf_rows=20, shrink=0.0)
KEY = ["product_id", "store_id", "date"]
PREDICTED = [*KEY, "sales_quantity", "prediction", "pred_lower", "pred_upper"]


def _levels(v):
    return level_list(v.table("customer").withColumnRenamed("c_mktsegment", "customer_segments"), "customer_segments")


def _features(v):
    rows = features.demand_features(stage(v.demand_indexed, "demand"), levels=_levels(v), shifted=True, daily_grain=True)
    return stage(rows, "features")


def _priced(v):
    return v.demand.withColumnRenamed("unit_price", "price")


@query("single_boosted_forecast", "M01")
def _(v):
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    model = forecast.fit_single(flat, CHECKED)
    return model.transform(flat).select(*KEY, "sales_quantity", "prediction")


@query("trend_forecast", "M02")
def _(v):
    rows = stage(v.demand.select(*KEY, "sales_quantity"), "history")
    return forecast.fit_trend(rows).transform(rows).select(*KEY, "sales_quantity", "trend_prediction")


@query("fold_metrics", "M03 M04 W06")
def _(v):
    return forecast.cross_validate(_features(v), CHECKED, CHECKED_LEAFWISE)


@query("ensemble_forecast", "M05 M03 M04 E20 E21")
def _(v):
    rows = _features(v)
    model = forecast.fit_ensemble(rows, CHECKED, CHECKED_LEAFWISE)
    return model.transform(rows).select(*PREDICTED)


@query("ensemble_performance", "M14 M09")
def _(v):
    rows = _features(v)
    return forecast.performance(forecast.fit_ensemble(rows, CHECKED, CHECKED_LEAFWISE), rows)


@query("backtest", "M10 W05 M09")
def _(v):
    return forecast.backtest(_features(v), 0.2, CHECKED, CHECKED_LEAFWISE)


@query("demand_outlook", "M07")
def _(v):
    return forecast.demand_outlook(stage(features.request_features(v.demand, _levels(v)), "outlook"), 30)


@query("batch_scores", "M08 E19 L02")
def _(v):
    rows = stage(_priced(v), "scoring")
    return forecast.score(forecast.fit_scorer(rows, CHECKED), rows).select(*KEY, "predicted_sales_quantity", "high_demand")


@query("feature_importance", "M11 L04")
def _(v):
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    model = forecast.fit_single(flat, CHECKED)
    return forecast.top_features(forecast.gain_importance(model, forecast.feature_names(flat), v.spark))


@query("trend_attribution", "M12 A13")
def _(v):
    rows = stage(v.demand.select(*KEY, "sales_quantity"), "history")
    return forecast.trend_attribution(forecast.fit_trend(rows), rows)


@query("permutation_importance", "M12 A13 L04")
def _(v):
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    return forecast.permutation_importance(forecast.fit_single(flat, CHECKED), flat)


@query("attribution_dependence", "M12")
def _(v):
    rows = stage(v.demand.select(*KEY, "sales_quantity"), "history")
    return forecast.dependence(forecast.fit_trend(rows), rows, "t", "t_weekly_sin_1").withColumn("value", F.round("value", 9))


@query("cover_importance", "M11")
def _(v):
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    return forecast.cover_importance(forecast.fit_single(flat, CHECKED), forecast.feature_names(flat), v.spark)


@query("boosted_dependence", "M12")
def _(v):
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    return forecast.boosted_dependence(forecast.fit_single(flat, CHECKED), flat, "unit_price", "month")


@query("mean_attribution", "A13 M12 L04")
def _(v):
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    return forecast.top_features(forecast.mean_attribution(forecast.fit_single(flat, CHECKED), flat))


# --- what SQL can say about them ---


@query("row_attributions", "M12 A13", f"select {K}, true as adds_up from demand", "demand")
def _(v):
    """The attributions of every row sum to its prediction less the mean one."""
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    model = forecast.fit_single(flat, CHECKED)
    rows = forecast.row_attributions(model, model.transform(flat))
    total = F.aggregate("attributions", F.lit(0.0), lambda a, x: a + x)
    return rows.select(*KEY, (F.abs(total - F.col("prediction") + F.col("expected")) <= 1e-8 * F.greatest(F.lit(1.0), F.abs("prediction"))).alias("adds_up"))


CALENDAR = ["day_of_week", "month", "year"]


@query(
    "tree_root_cut",
    "M03 M04",
    """, r as (select sales_quantity - avg(sales_quantity) over () as r, dt from demand),
       u as (select 'day_of_week' as feature, isodow(dt) - 1 as v, r from r union all select 'month', month(dt), r from r union all select 'year', year(dt), r from r),
       c as (select feature, v, sum(r) as g, count(*) as n from u group by all),
       k as (select feature, v, sum(g) over w as gl, sum(n) over w as nl, sum(g) over (partition by feature) as g, sum(n) over (partition by feature) as n
             from c window w as (partition by feature order by v)),
       s as (select feature, v::double as cut, gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n as gain, gl / nl as low, (g - gl) / (n - nl) as high from k where nl < n)
       select feature, cut, round(gain, 3) as gain, round(low, 6) as low, round(high, 6) as high from s order by s.gain desc limit 1""",
    "demand",
)
def _(v):
    """The best first cut of all rows among three calendar columns, and the values of both sides."""
    rows = stage(features.flat_features(v.demand, _levels(v)).select(*CALENDAR, forecast.TARGET), "root")
    whole = boosting.Growth(rate=1.0, depth=1, shrink=0.0, row_share=1.0, column_share=1.0)
    marked = rows.withColumns({"w": F.lit(1.0), "held": F.lit(False)})
    tree = boosting.fit_trees(marked, CALENDAR, whole, 1, 1, forecast.TARGET, "w", "held", "p").trees[0]
    found = [(CALENDAR[tree.feature[0]], tree.cut[0], tree.gain[0], tree.value[tree.left[0]], tree.value[tree.right[0]])]
    out = v.spark.createDataFrame(found, "feature string, cut double, gain double, low double, high double")
    return rounded(rounded(out, "gain", digits=3), "low", "high")

FEATURE_ROWS = f"""select * from (select {K}, sales_quantity, lag(sales_quantity, 30) over ({W}) as back,
    count(*) over ({W} rows between 30 preceding and 1 preceding) as there from demand) where back is not null and there = 30"""


@query(
    "ensemble_identities",
    "M05 E20 E21",
    f"select product_id, store_id, date, sales_quantity, true as blend_holds, true as bounds_hold from ({FEATURE_ROWS})",
    "demand",
)
def _(v):
    rows = _features(v)
    scored = forecast.fit_ensemble(rows, CHECKED, CHECKED_LEAFWISE).transform(rows)
    blend = 0.4 * F.col("trend_prediction") + 0.3 * F.col("boosted_prediction") + 0.3 * F.col("leafwise_prediction")
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))
    p = F.col("prediction")
    return scored.select(
        *KEY,
        "sales_quantity",
        near(p, blend).alias("blend_holds"),
        (near(F.col("pred_lower"), 0.9 * p) & near(F.col("pred_upper"), 1.1 * p)).alias("bounds_hold"),
    )


@query(
    "trend_term_values",
    "M02",
    f"""select {K}, round(t, 9) as t, round(greatest(t - 0.32::double, 0), 9) as t_hinge_10, round(sin(2 * pi() * 1 * d / 7.0::double), 9) as t_weekly_sin_1,
              round(cos(2 * pi() * 2 * d / 365.25::double), 9) as t_yearly_cos_2
       from (select *, (dt - lo)::double as d, (dt - lo)::double / (hi - lo)::double as t from demand, (select min(dt) as lo, max(dt) as hi from demand))""",
    "demand",
)
def _(v):
    rows = stage(v.demand.select(*KEY), "history")
    terms = forecast.trend_terms(*forecast._span(rows), forecast.SEASONS)
    names = ["t", "t_hinge_10", "t_weekly_sin_1", "t_yearly_cos_2"]
    return rounded(rows.select(*KEY, *[F.expr(terms[n]).alias(n) for n in names]), *names, digits=9)


@query(
    "outlook_dates",
    "M07",
    """select cast(dt as varchar) as ds, true as ordered from demand group by dt
       union all select cast((select max(dt) from demand) + cast(i as integer) as varchar), true from range(1, 31) r(i)""",
    "demand",
)
def _(v):
    out = forecast.demand_outlook(stage(features.request_features(v.demand, _levels(v)), "outlook"), 30)
    return out.select("ds", ((F.col("yhat_lower") < F.col("yhat")) & (F.col("yhat") < F.col("yhat_upper"))).alias("ordered"))


@query("score_flags", "M08 E19", f"select {K}, true as flag_holds from demand", "demand")
def _(v):
    rows = stage(_priced(v), "scoring")
    scored = forecast.score(forecast.fit_scorer(rows, CHECKED), rows)
    cut = scored.agg(F.percentile("predicted_sales_quantity", 0.75).alias("cut")).scalar()
    holds = F.col("high_demand") == (F.col("predicted_sales_quantity") > F.col("cut") + F.lit(1e-9))
    near = F.abs(F.col("predicted_sales_quantity") - F.col("cut")) <= 1e-9
    return scored.withColumn("cut", cut).select(*KEY, (holds | near).alias("flag_holds"))


@query("backtest_size", "M10 W05", f"select cast(trunc(count(*) * 0.2::double) as bigint) as test_size, true as scored from ({FEATURE_ROWS})", "demand")
def _(v):
    out = forecast.backtest(_features(v), 0.2, CHECKED, CHECKED_LEAFWISE)
    return out.select("test_size", (F.col("mae") > 0).alias("scored"))


@query(
    "fold_names",
    "M03 M04 W06",
    "select model, f::int as fold, true as scored from (values ('boosted'), ('leafwise')) m(model), range(1, 6) r(f) where exists (select 1 from lineitem)",
)
def _(v):
    out = forecast.cross_validate(_features(v), CHECKED, CHECKED_LEAFWISE)
    return out.select("model", "fold", (F.col("mae") > 0).alias("scored"))


@query(
    "importance_sums",
    "M11 L04 A13",
    "select 'gain' as kind, true as holds from lineitem group by 1 union all select 'cover', true from lineitem group by 1 union all select 'trend', true from lineitem group by 1",
)
def _(v):
    flat = stage(features.flat_features(v.demand, _levels(v)), "flat")
    names = forecast.feature_names(flat)
    model = forecast.fit_single(flat, CHECKED)
    history = stage(v.demand.select(*KEY, "sales_quantity"), "history")
    gain = forecast.gain_importance(model, names, v.spark).agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("holds"))
    # a split covers no more rows than there are, and the first splits cover them all
    n = float(flat.count())
    cover = forecast.cover_importance(model, names, v.spark).agg(((F.max("importance") <= n) & (F.min("importance") >= 0)).alias("holds"))
    trend = forecast.trend_attribution(forecast.fit_trend(history), history).agg((F.min("importance") >= 0).alias("holds"))
    parts = [df.select(F.lit(kind).alias("kind"), "holds") for kind, df in (("gain", gain), ("cover", cover), ("trend", trend))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
