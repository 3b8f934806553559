import datetime as dt
import math
from dataclasses import replace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from larder.operators.summaries import level_list
from larder.plans import features, forecast
from larder.plans.boosting import best_prefix
from larder.plans.evaluate import evaluate
from larder.sources.models import load_model, save_model

QUICK = forecast.Boosting(rounds=2, patience=1, rate=0.1, depth=3)
LEVELS = ["Premium", "Regular"]


@pytest.fixture(scope="module")
def demand(spark):
    rows = []
    for p in range(3):
        for i in range(120):
            day = dt.date(2023, 1, 1) + dt.timedelta(days=i)
            sales = 40 + 10 * p + 0.2 * i + 8 * math.sin(2 * math.pi * i / 7)
            rows.append(
                (f"P{p}", "S1", day, sales, 10.0 + p, 10.0 + p, "Yes" if i % 5 == 0 else "No", "Festival" if i % 30 == 0 else "None",
                 "Weather" if i % 4 == 0 else "Competitor", "Stable" if i % 2 else "Increasing", LEVELS[i % 2])
            )
    return spark.createDataFrame(
        rows,
        "product_id string, store_id string, date date, sales_quantity double, price double, unit_price double, promotions string,"
        " seasonality_factors string, external_factors string, demand_trend string, customer_segments string",
    )


@pytest.fixture(scope="module")
def table(demand):
    return features.demand_features(demand, shifted=True, daily_grain=True).persist()


def test_trend_model_follows_trend_and_week(demand):
    one = demand.where("product_id = 'P0'")
    scored = forecast.fit_trend(one, shrink=0.001).transform(one)
    assert evaluate(scored, predicted="trend_prediction").first()["wmape"] < 0.05
    assert not [c for c in scored.columns if c.startswith("t_")]


def test_ensemble_blend_bounds_and_saved_copy(spark, table, tmp_path):
    model = forecast.fit_ensemble(table, QUICK, QUICK)
    scored = model.transform(table)
    row = scored.first()
    blended = 0.4 * row["trend_prediction"] + 0.3 * row["boosted_prediction"] + 0.3 * row["leafwise_prediction"]
    assert row["prediction"] == pytest.approx(blended)
    assert (row["pred_lower"], row["pred_upper"]) == (pytest.approx(0.9 * blended), pytest.approx(1.1 * blended))
    assert scored.count() == table.count()
    save_model(model, str(tmp_path / "model"), {"levels": LEVELS}, spark)
    again, settings = load_model(str(tmp_path / "model"), spark)
    assert settings == {"levels": LEVELS}
    key = ["product_id", "date"]
    assert sorted(rows_of(again.transform(table), *key, "prediction")) == sorted(rows_of(scored, *key, "prediction"))
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "none"), spark)
    metrics = forecast.performance(model, table).first().asDict()
    assert {"mae", "mape", "wmape", "bias", "coverage_90", "high_value_mae", "revenue_loss"} <= set(metrics)


def test_backtest_holds_out_the_last_fifth(table):
    row = forecast.backtest(table, 0.2, QUICK, QUICK).first()
    assert row["test_size"] == int(table.count() * 0.2)
    assert row["mae"] > 0


def test_single_model_and_importance(spark, demand):
    flat = features.flat_features(demand, LEVELS).persist()
    names = forecast.feature_names(flat)
    assert "sales_quantity" not in names and "segment_regular" in names and "is_weekend" not in names
    model = forecast.fit_single(flat, QUICK)
    gain = forecast.gain_importance(model, names, spark)
    assert sum(r["importance"] for r in gain.collect()) == pytest.approx(1.0)
    assert forecast.top_features(gain, 3).count() == 3
    moved = {r["feature"]: r["importance"] for r in forecast.permutation_importance(model, flat).collect()}
    assert set(moved) == set(names)
    unused = [r["feature"] for r in gain.collect() if r["importance"] == 0.0]
    assert all(moved[f] == pytest.approx(0.0, abs=1e-9) for f in unused)
    assert max(moved.values()) > 0


def test_scoring_refuses_new_labels(demand):
    model = forecast.fit_scorer(demand, QUICK)
    scored = forecast.score(model, demand)
    rows = scored.collect()
    values = [r["predicted_sales_quantity"] for r in rows]
    assert values == sorted(values, reverse=True)
    assert 0 < sum(r["high_demand"] for r in rows) <= len(rows) / 4
    strange = demand.withColumn("promotions", F.lit("Maybe"))
    with pytest.raises(Exception, match="(?i)unseen|label"):
        forecast.score(model, strange).collect()


def test_outlook_covers_history_and_future(demand):
    coded = features.request_features(demand, level_list(demand, "customer_segments"))
    out = forecast.demand_outlook(coded, periods=30).orderBy("ds").collect()
    assert len(out) == 120 + 30
    assert out[-1]["ds"] == dt.date(2023, 4, 30) + dt.timedelta(days=30)
    assert all(r["yhat_lower"] < r["yhat"] < r["yhat_upper"] for r in out)


def test_attribution_of_trend_terms(demand):
    one = demand.where("product_id = 'P0'").persist()
    model = forecast.fit_trend(one)
    table = {r["feature"]: r["importance"] for r in forecast.trend_attribution(model, one).collect()}
    assert table["t_weekly_sin_1"] > table["t_weekly_sin_3"]
    line = forecast.dependence(model, one, "t_weekly_sin_1", "t")
    assert line.count() == 120
    assert line.agg(F.avg(F.abs("attribution"))).first()[0] == pytest.approx(table["t_weekly_sin_1"])


def test_fold_metrics(table):
    out = forecast.cross_validate(table, QUICK, QUICK, folds=2)
    assert sorted(rows_of(out, "model", "fold")) == [("boosted", 1), ("boosted", 2), ("leafwise", 1), ("leafwise", 2)]


def test_defaults_grow_many_trees_and_beat_the_trend(demand):
    """Default rate, patience and stop rule; the most rounds cut so that the test ends soon."""
    rows = features.flat_features(demand, LEVELS).withColumn("level", F.substring("product_id", 2, 1).cast("int"))
    held = rows.where("date >= date'2023-04-10'")
    model = forecast.fit_single(rows.where("date < date'2023-04-10'"), replace(forecast.BOOSTED, rounds=40, rate=0.08, depth=4))
    booster = model.stages[-1]
    assert booster.getNumTrees > 20
    trend = forecast.fit_trend(demand.where("date < date'2023-04-10'"))
    own = evaluate(model.transform(held)).first()["mae"]
    other = evaluate(trend.transform(demand.where("date >= date'2023-04-10'")), predicted="trend_prediction").first()["mae"]
    assert own < other


def test_stop_rule_keeps_the_best_prefix():
    assert best_prefix([5.0, 4.0, 3.0, 3.5, 3.4], 2) == 2
    assert best_prefix([5.0, 4.0, 3.0, 3.5, 2.0], 2) is None
    assert best_prefix([5.0, 4.99, 4.98, 4.97], 1) is None  # small gains do not end it


def test_scorer_takes_more_labels_than_bins(spark):
    rows = spark.range(800).selectExpr(
        "concat('S', id % 400) as store_id", "concat('P', id % 3) as product_id", "date_add(date'2023-01-01', cast(id % 60 as int)) as date",
        "cast(id % 17 as double) as sales_quantity", "cast(id % 5 as double) as price", "'Yes' as promotions", "'None' as seasonality_factors",
        "'None' as external_factors", "'Stable' as demand_trend", "'A' as customer_segments",
    )
    assert forecast.score(forecast.fit_scorer(rows, QUICK), rows).count() == 800


def test_cover_and_boosted_dependence(spark, demand):
    flat = features.flat_features(demand, LEVELS).withColumn("level", F.substring("product_id", 2, 1).cast("int")).persist()
    names = forecast.feature_names(flat)
    model = forecast.fit_single(flat, QUICK)
    cover = {r["feature"]: r["importance"] for r in forecast.cover_importance(model, names, spark).collect()}
    gain = {r["feature"]: r["importance"] for r in forecast.gain_importance(model, names, spark).collect()}
    assert set(cover) == set(names) and {f for f in names if cover[f] > 0} == {f for f in names if gain[f] > 0}
    assert max(cover.values()) <= flat.count()
    best = max(gain, key=gain.get)
    shown = forecast.boosted_dependence(model, flat, best, "month").collect()
    assert len(shown) == flat.count() and {r["interaction"] for r in shown} == {1.0, 2.0, 3.0, 4.0}
    assert max(abs(r["attribution"]) for r in shown) > 0
    unused = next(f for f in names if gain[f] == 0)
    assert all(abs(r["attribution"]) < 1e-9 for r in forecast.boosted_dependence(model, flat, unused).collect())


def test_row_attributions_add_up_to_the_prediction(demand):
    flat = features.flat_features(demand, LEVELS).persist()
    model = forecast.fit_single(flat, QUICK)
    rows = forecast.row_attributions(model, model.transform(flat)).collect()
    assert all(sum(r["attributions"]) == pytest.approx(r["prediction"] - r["expected"]) for r in rows)
    mean = {r["feature"]: r["importance"] for r in forecast.mean_attribution(model, flat).collect()}
    names = forecast.feature_names(flat)
    assert set(mean) == set(names)
    for i, n in enumerate(names):
        assert mean[n] == pytest.approx(sum(abs(r["attributions"][i]) for r in rows) / len(rows))


def test_second_booster_has_at_most_31_leaves(table):
    model = forecast.fit_ensemble(table, QUICK, replace(forecast.LEAFWISE, rounds=2, rate=0.3))
    trees = forecast._boosters(model)[1].trees
    assert trees and all(t.leaves <= 31 for t in trees) and max(t.leaves for t in trees) > 4  # 270 rows, 20 in each leaf
