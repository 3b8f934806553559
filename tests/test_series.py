import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from larder.functions.calendar import date_parts, holiday_dimension, us_holiday
from larder.functions.encoders import SEASON_CODES, coded, factor_flags, one_hot
from larder.operators.matching import with_holidays
from larder.operators import positions, quantiles
from larder.operators.positions import chronological_holdout, expanding_folds, with_positions
from larder.operators.quantiles import exact_quantiles
from larder.operators.windows import lag_columns, naive_forecast, over_series, seasonal_decomposition, with_history
from larder.plans import evaluate, features
from larder.schemas import KEYS


@pytest.fixture
def demand(spark):
    start = dt.date(2024, 1, 1)
    rows = []
    for i in range(31):
        day = start + dt.timedelta(days=i)
        sales = 50 + i % 7 + (20 if day.weekday() == 5 else 0) + (30 if day.day == 1 else 0) + (40 if i == 15 else 0)
        rows.append((day, "P1", "S1", float(sales), 10.0, "No", "Holiday" if i == 15 else "None", "None", "Stable", "Regular"))
    return spark.createDataFrame(
        rows,
        "date date, product_id string, store_id string, sales_quantity double, price double, promotions string,"
        " seasonality_factors string, external_factors string, demand_trend string, customer_segments string",
    )


def test_features_of_one_month(demand):
    out = features.demand_features(demand, keep_incomplete=True).orderBy("date").collect()
    assert sum(r["lag_30"] is not None for r in out) == 1
    assert [r["rolling_7_mean"] is None for r in out] == [True] * 6 + [False] * 25
    assert [r["rolling_30_mean"] is None for r in out] == [True] * 29 + [False] * 2
    assert {r["promotions_code"] for r in out} <= {0, 1}
    assert out[0]["is_holiday"] == 1 and out[14]["is_holiday"] == 1 and out[1]["is_holiday"] == 0
    assert {"segment_regular", "has_competitor", "promo_season_interaction", "is_weekend"} <= set(out[0].asDict())
    assert features.demand_features(demand).count() == 1


@pytest.mark.parametrize("shifted", [False, True])
def test_history_matches_pandas_however_it_is_cut(spark, shifted):
    rng = random.Random(4)
    rows, day = [], dt.date(2024, 1, 1)
    for key, n in [("LONG", 230), ("MID", 60), ("SHORT", 5), (None, 90)]:
        for i in range(n):
            rows.append((key, "S", day + dt.timedelta(days=i), None if rng.random() < 0.05 else float(rng.randrange(50))))
    df = spark.createDataFrame(rows, "product_id string, store_id string, date date, sales_quantity double")
    pdf = pd.DataFrame(rows, columns=["product_id", "store_id", "date", "sales_quantity"])
    groups = pdf.groupby("product_id", dropna=False)["sales_quantity"]
    for n in (1, 7, 30):
        pdf[f"lag_{n}"] = groups.shift(n)
    for n in (7, 30):
        pdf[f"rolling_{n}_mean"] = groups.transform(lambda s, n=n: (s.shift(1) if shifted else s).rolling(n).mean())
    expected = {
        (r.product_id if isinstance(r.product_id, str) else None, r.date): [None if math.isnan(x) else x for x in r[4:]]
        for r in pdf.itertuples(index=False, name="R")
    }
    for limits in ({"daily_grain": True}, {"block_rows": 35}, {"block_rows": 1000}):
        out = with_history(df, KEYS, ["date"], "sales_quantity", shifted=shifted, **limits).collect()
        assert len(out) == len(rows)
        for r in out:
            got = [r["lag_1"], r["lag_7"], r["lag_30"], r["rolling_7_mean"], r["rolling_30_mean"]]
            assert got == pytest.approx(expected[r["product_id"], r["date"]])


def test_blocks_must_cover_the_frame(demand):
    with pytest.raises(ValueError):
        with_history(demand, KEYS, ["date"], "sales_quantity", block_rows=10)


def test_naive_forecast(demand):
    out = naive_forecast(demand, KEYS, ["date"]).orderBy("date").limit(2).collect()
    assert [r["predicted_demand"] for r in out] == [80.0, (80.0 + 51.0) / 2]


@pytest.mark.parametrize("period,block_rows", [(7, None), (7, 20), (4, None), (4, 16)])
def test_decomposition(spark, period, block_rows):
    n = 53
    y = np.array([10 + 0.5 * i + [0, 3, -1, 4, -2, 5, 1][i % 7] + (i * 37 % 5) for i in range(n)], dtype=float)
    start = dt.date(2024, 1, 1)
    rows = [("P", "S", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)] + [("Q", "S", start, 1.0)]
    df = spark.createDataFrame(rows, "product_id string, store_id string, date date, sales_quantity double")
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = period // 2
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(y, weights, "valid")
    means = np.array([np.nanmean((y - trend)[p::period]) for p in range(period)])
    seasonal = np.resize(means - means.mean(), n)
    limits = {"daily_grain": True} if block_rows is None else {"block_rows": block_rows}
    out = seasonal_decomposition(df, KEYS, ["date"], period=period, **limits).where("product_id = 'P'").orderBy("date").toPandas()
    np.testing.assert_allclose(out["trend"].to_numpy(dtype=float), trend)
    np.testing.assert_allclose(out["seasonal"], seasonal, atol=1e-9)
    np.testing.assert_allclose(out["residual"].to_numpy(dtype=float), y - trend - seasonal, atol=1e-9)
    short = seasonal_decomposition(df, KEYS, ["date"], period=period, **limits).where("product_id = 'Q'").first()
    assert (short["trend"], short["seasonal"], short["residual"]) == (None, None, None)


def test_positions_with_one_day_holding_most_rows(spark, many_ranges):
    rows = [(dt.date(2024, 1, 2) if i % 3 else dt.date(2024, 1, 1 + i % 28), f"P{i % 5}") for i in range(500)]
    df = spark.createDataFrame(rows, "date date, product_id string")
    out = with_positions(df, ["date", "product_id"]).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(500))
    assert [(r["date"], r["product_id"]) for r in out] == sorted(rows)


def test_holdout_and_folds(spark, many_ranges):
    df = spark.range(103).selectExpr("date_add(date'2024-01-01', cast(id as int)) as date", "id")
    split = chronological_holdout(df, ["date"]).collect()
    assert sorted(r["id"] for r in split if r["is_test"]) == list(range(83, 103))
    folds = expanding_folds(df, ["date"], 5).collect()
    test = 103 // 6
    for r in folds:
        start = 103 - 5 * test
        assert r["fold"] == (0 if r["id"] < start else (r["id"] - start) // test + 1)
    tiny = expanding_folds(df.limit(3), ["date"], 5).collect()
    assert {r["fold"] for r in tiny} == {0}


def test_quantiles_match_numpy(spark, many_ranges):
    rng = np.random.default_rng(5)
    values = np.r_[rng.normal(size=300), np.repeat(0.25, 200)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.75, 0.8, 1.0])
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert exact_quantiles(df.where("v is null"), "v", [0.5]) == {0.5: None}


def test_known_holidays(spark):
    days = {
        "2024-01-01": "New Year's Day", "2024-01-15": "Martin Luther King Jr. Day", "2024-02-19": "Washington's Birthday",
        "2024-05-27": "Memorial Day", "2024-06-19": "Juneteenth", "2024-07-04": "Independence Day", "2024-09-02": "Labor Day",
        "2024-10-14": "Columbus Day", "2024-11-11": "Veterans Day", "2024-11-28": "Thanksgiving", "2024-12-25": "Christmas Day",
        "2021-12-31": "New Year's Day (observed)", "2021-07-05": "Independence Day (observed)", "2020-06-19": None, "2024-03-01": None,
    }
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", us_holiday(F.col("d").cast("date")).alias("h"))
    assert {r["d"]: r["h"] for r in df.collect()} == days
    table = holiday_dimension(spark, 2024, 2024)
    assert table.count() == 11
    joined = with_holidays(df.select(F.col("d").cast("date").alias("date")), table)
    assert joined.where("holiday is not null").count() == 11


def test_date_parts(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in date_parts(F.lit("2024-06-30").cast("date")).items()]).first()
    assert tuple(row) == (6, 30, 6, 2024, 1)


def test_encodings(spark):
    df = spark.createDataFrame([("Festival", "Bad Weather", "B x"), ("None", None, None), ("?", "Competitor Weather", "A")], "s string, external_factors string, g string")
    assert [r[0] for r in df.select(coded(F.col("s"), SEASON_CODES)).collect()] == [2, 0, None]
    assert [r[0] for r in df.select(coded(F.col("s"), SEASON_CODES, fill=0)).collect()] == [2, 0, 0]
    flags = df.select(*[c.alias(n) for n, c in factor_flags(df.columns).items()])
    assert rows_of(flags) == [(0, 1, 0), (0, 0, 0), (1, 1, 0)]
    assert rows_of(df.select(*[c.alias(n) for n, c in factor_flags(["g"]).items()]))[0] == (0, 0, 0)
    hot = one_hot("g", ["B x", "A"])
    assert list(hot) == ["segment_a", "segment_b_x"]
    assert rows_of(df.select(*hot.values())) == [(0, 1), (0, 0), (1, 0)]
    assert list(one_hot("g", ["B x", "A"], drop_first=True)) == ["segment_b_x"]


def test_promotion_without_budget_is_zero(spark):
    df = spark.createDataFrame([(0, 3), (0, 4)], "promotion_budget int, promotion_days int")
    out = features.with_effects(df).collect()
    assert [r["promo_intensity"] for r in out] == [0.0, 0.0]
    some = spark.createDataFrame([(5,), (10,)], "promotion_budget int")
    assert sorted(r["promo_intensity"] for r in features.with_effects(some).collect()) == [0.5, 1.0]


def test_metrics(spark):
    rows = [(10.0, 12.0, 2.0, 1), (20.0, 15.0, 3.0, 0), (0.0, 1.0, 1.0, 1), (5.0, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "sales_quantity double, prediction double, unit_price double, is_high_value int")
    m = evaluate.evaluate(df).first().asDict()
    assert m["mae"] == pytest.approx(8 / 3)
    assert m["wmape"] == pytest.approx(8 / 30)
    assert m["bias"] == pytest.approx(-2 / 3)
    assert m["mape"] == pytest.approx((0.2 + 0.25 + 1 / np.finfo(float).eps) / 3)
    assert (m["coverage_10"], m["coverage_50"]) == (0.0, pytest.approx(2 / 3))
    assert m["high_value_mae"] == 1.5 and m["high_value_wmape"] == pytest.approx(0.3)
    assert (m["revenue_loss"], m["revenue_excess"]) == (15.0, 5.0)
    assert m["total_business_impact"] == pytest.approx(15 + 5 + 1)
    plain = evaluate.evaluate(df.drop("unit_price", "is_high_value"))
    assert "revenue_loss" not in plain.columns and "high_value_mae" not in plain.columns


def test_a_false_claim_of_daily_grain_is_an_error(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 3.0)], "k string, d int, v double")
    with pytest.raises(Exception, match="daily grain"):
        over_series(rows, ["k"], ["d"], lag_columns("v", [1]), 1, daily_grain=True).collect()
    out = over_series(rows, ["k"], ["d"], lag_columns("v", [1]), 1, block_rows=2)
    again = over_series(rows.repartition(3), ["k"], ["d"], lag_columns("v", [1]), 1, block_rows=2)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("collect", [0, 200])
def test_quantiles_are_closed_in_round_by_round(spark, monkeypatch, collect):
    monkeypatch.setattr(quantiles, "COLLECT", collect)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = np.random.default_rng(4)
    heavy = [7.0] * 900 + [-1e300, 1e300, 0.0, -0.0] + list(np.exp(rng.normal(size=600) * 20)) + [math.nan]
    for values in (heavy, [1.0] * 500 + [2.0] * 500):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        plain = np.array([v for v in values if not math.isnan(v)])
        got = exact_quantiles(df, "v", [0.0, 0.25, 0.8])
        for q, v in got.items():
            assert v == pytest.approx(np.quantile(plain, q), rel=1e-12)


@pytest.mark.parametrize("most", [10_000_000, 5])
def test_two_level_positions_are_the_global_order(spark, many_ranges, monkeypatch, most):
    monkeypatch.setattr(positions, "DAY_ROWS", most)
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.05 else dt.date(2023, 1, 1 + rng.randrange(9) // 2), rng.choice(["a", "b", None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "date date, product_id string, nr int").repartition(4)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.date.min, r[1] is not None, r[1] or "", r[2]))
    order = ["date", "product_id", "nr"]
    split = {r["position"]: (r["nr"], r["is_test"]) for r in chronological_holdout(df, order).collect()}
    assert split == {i: (r[2], i >= 320) for i, r in enumerate(want)}
    folds = {r["position"]: (r["nr"], r["fold"]) for r in expanding_folds(df, order, 5).collect()}
    assert folds == {i: (r[2], 0 if i < 70 else (i - 70) // 66 + 1) for i, r in enumerate(want)}
    assert chronological_holdout(df.limit(0), order).count() == 0 and expanding_folds(df.limit(3), order).agg({"fold": "max"}).first()[0] == 0
