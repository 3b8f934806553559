import math

import pytest
from conftest import SCHEMA_INV, rows_of
from pyspark.sql import functions as F

from larder.functions.ratios import impact_label, pct_change, safe_ratio
from larder.functions.stock import picked_demand, reorder_point, reorder_qty, safety_stock
from larder.operators.balance import redistributed_inventory, redistribution, transfer_summary
from larder.operators.checks import is_empty, profile, require, schema_report, split_rejects
from larder.operators.columns import (
    attach_predictions,
    backfill_store,
    nan_to_null,
    normal_forecast,
    parse_date,
    standard_names,
    trim_headings,
    with_defaults,
)
from larder.operators.matching import match, match_or_product, match_suffixed, product_filter
from larder.operators.summaries import histogram, level_list, segment_vector, shares, stock_maps, stock_matrix
from larder.plans import monitor, pricing, reorder, reports


def test_reorder_suggestions_follow_the_formula(inventory, forecast):
    out = reorder.by_urgency(reorder.reorder_suggestions(forecast, inventory))
    assert rows_of(out, "product_id", "predicted_demand", "lead_time_days", "safety_stock", "reorder_qty") == [
        ("P1002", 25.0, 5, 5, 20),
        ("P1001", 60.0, 7, 12, 22),
    ]


@pytest.mark.parametrize("demand,stock,qty", [(0.0, 100, 0), (50.0, 100, 0), (None, 10, 0), (60.0, 50, 22), (2.9, 1, 2)])
def test_order_quantity(spark, demand, stock, qty):
    df = spark.createDataFrame([(demand, stock)], "d double, s long")
    assert df.select(reorder_qty(F.col("d"), F.col("s"))).first()[0] == qty


def test_unknown_product_gives_empty_frame_with_schema(spark, inventory):
    unknown = spark.createDataFrame([("P9999", "S001", 5.0)], "product_id string, store_id string, predicted_demand double")
    out = reorder.reorder_suggestions(unknown, inventory)
    assert is_empty(out)
    assert "reorder_qty" in out.columns


def test_missing_stock_column_is_refused(inventory, forecast):
    with pytest.raises(ValueError, match="stock_levels"):
        reorder.reorder_suggestions(forecast, inventory.drop("stock_levels"))
    with pytest.raises(ValueError):
        require(inventory, ["nope"])


def test_product_fallback_only_when_nothing_matches(spark, inventory, forecast):
    elsewhere = forecast.withColumn("store_id", F.lit("X"))
    out = match_or_product(elsewhere, inventory)
    assert sorted(rows_of(out, "product_id", "store_id")) == [("P1001", "S001"), ("P1002", "S001"), ("P1003", "S002")]
    one = elsewhere.withColumn("store_id", F.when(F.col("product_id") == "P1003", "S002").otherwise("X"))
    assert rows_of(match_or_product(one, inventory), "product_id") == [("P1003",)]


def test_demand_pick(spark):
    rows = [(1.0, 5.0), (0.0, 5.0), (None, 5.0), (0.0, None)]
    both = spark.createDataFrame(rows, "predicted_sales_quantity double, predicted_demand double")
    assert [r[0] for r in both.select(picked_demand(both.columns)).collect()] == [1.0, 5.0, None, None]
    only = both.drop("predicted_demand")
    assert [r[0] for r in only.select(picked_demand(only.columns)).collect()] == [1.0, None, None, None]
    other = both.drop("predicted_sales_quantity")
    assert [r[0] for r in other.select(picked_demand(other.columns)).collect()] == [5.0, 5.0, 5.0, None]
    with pytest.raises(ValueError):
        picked_demand(["price"])


def test_forecast_shapes(spark):
    new = spark.createDataFrame([("p", "s", 10.0, 9.0, 11.0)], "product_id string, store_id string, prediction double, pred_lower double, pred_upper double")
    assert normal_forecast(new).columns == ["product_id", "store_id", "predicted_demand", "pred_lower", "pred_upper"]
    assert rows_of(normal_forecast(new), "predicted_demand") == [(10.0,)]


def test_log_appended_twice_doubles(inventory, forecast):
    s = reorder.reorder_suggestions(forecast, inventory)
    log = reorder.reorder_log(s, "2024-06-30 08:00:00")
    twice = reorder.reorder_log(s, "2024-07-01 08:00:00", log)
    assert log.count() == 2 and twice.count() == 4
    assert set(rows_of(twice, "triggered_by")) == {("Auto-System",)}


def test_apply_reorders(spark):
    inv = spark.createDataFrame(
        [(1001, "STORE001", 50, 20), (1002, "STORE001", 30, 15), (1001, "STORE002", 40, 25), (1003, "STORE002", 60, 30)],
        "product_id int, store_id string, stock_levels long, reorder_point long",
    )
    orders = spark.createDataFrame(
        [(1001, "STORE001", 25), (1002, "STORE001", 15), (1003, "STORE002", 20), (1004, "STORE001", 10)],
        "product_id int, store_id string, reorder_qty long",
    )
    updated, done, rejected = reorder.apply_reorders(orders, inv, "2025-04-09 13:50:18")
    assert sorted(rows_of(updated, "product_id", "store_id", "stock_levels")) == [
        (1001, "STORE001", 75), (1001, "STORE002", 40), (1002, "STORE001", 45), (1003, "STORE002", 80),
    ]
    assert sorted(rows_of(done, "product_id", "reorder_qty", "status", "processed_at"))[0] == (1001, 25, "Auto-Reordered", "2025-04-09 13:50:18")
    assert done.count() == 3
    assert rows_of(rejected, "product_id") == [(1004,)]
    again, _, _ = reorder.apply_reorders(orders.union(orders), inv, "2025-04-09 13:50:18")
    assert again.agg(F.sum("stock_levels")).first()[0] == 180 + 2 * 60


def test_audit_is_strict(inventory, forecast):
    sales = forecast.withColumnRenamed("predicted_demand", "predicted_sales_quantity")
    assert rows_of(pricing.audit(inventory, sales), "product_id", "stock_gap", "flag") == [("P1003", 25.0, "Mismatch")]
    assert rows_of(pricing.audit(inventory, sales, 15), "product_id") == [("P1003",)]
    assert pricing.audit(inventory, sales, 9).count() == 3


@pytest.fixture
def monitored(spark):
    rows = [
        ("P1001", "S001", 15, 20, "2024-12-31", 15), ("P1002", "S001", 50, 30, "2024-06-15", 80),
        ("P1003", "S002", 10, 15, "2024-05-01", 5), ("P1004", "S002", 30, 25, "2024-07-30", 50),
        ("P1005", "S002", 25, 25, "not a date", 50),
    ]
    df = spark.createDataFrame(rows, SCHEMA_INV + ", expiry_date string, warehouse_capacity long")
    return df.withColumn("expiry_date", parse_date(F.col("expiry_date")))


def test_report(monitored):
    report = monitor.inventory_report(monitored, "2024-06-30")
    assert dict(rows_of(report)) == {"stockout_risk": 2, "expiring_soon": 3, "low_capacity": 2}
    assert sorted(rows_of(monitor.report_lines(report))) == [
        ("Expiring soon: 3 items",), ("Low warehouse capacity items: 2",), ("Stockout risk: 2 items",),
    ]
    assert monitor.stockouts(monitored, inclusive=True).count() == 3


def test_kpis(monitored):
    row = monitor.kpis(monitored, "P1003", "S002", as_of="2024-06-30").first()
    assert (row["stockout_risk"], row["expiring_soon"], row["low_capacity"]) == (1, 1, 1)
    given = monitored.withColumn("days_to_expiry", F.lit(31))
    assert monitor.kpis(given).first()["expiring_soon"] == 0


def test_strict_dates_fail(spark):
    bad = spark.createDataFrame([("x",)], "d string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(parse_date(F.col("d"), strict=True)).collect()


def test_prices(spark):
    rows = [("P1001", 100, 50), ("P1002", 50, 200), ("P1003", 200, 100), ("P1004", 75, 50), ("P5", 5, 0), ("P6", 0, 0)]
    df = spark.createDataFrame(rows, "product_id string, price long, sales_volume long")
    out = {r["product_id"]: (r["price_to_sales"], r["status"]) for r in pricing.price_flags(df).collect()}
    assert out == {
        "P1001": (2.0, "Overpriced"), "P1002": (0.25, "Underpriced"), "P1003": (2.0, "Overpriced"), "P5": (math.inf, "Overpriced"),
    }
    assert pricing.overpriced(df).count() == 3 and pricing.underpriced(df).count() == 1


def test_ratio_signs(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (1.0, 4.0)], "n double, d double")
    assert [r[0] for r in df.select(safe_ratio(F.col("n"), F.col("d"))).collect()] == [math.inf, -math.inf, None, None, 0.25]


def test_sales_impact_known_rows(spark):
    prices = spark.createDataFrame(
        [("2868", "45", 23.87, 36.91, 320.0), ("1174", "49", 10.37, 69.83, 41.0)],
        "product_id string, store_id string, price double, `competitor_prices ` double, sales_volume double",
    )
    predicted = spark.createDataFrame(
        [("2868", "45", 25.31, 288.08978), ("1174", "49", 70.38, 332.00912)],
        "product_id string, store_id string, price double, predicted_sales_quantity double",
    )
    out = {r["product_id"]: r for r in pricing.sales_impact(prices, predicted).collect()}
    assert out["2868"]["price_change_pct"] == pytest.approx(-35.329179084258996)
    assert out["2868"]["sales_lift_pct"] == pytest.approx(11.076484559778544)
    assert (out["2868"]["impact"], out["1174"]["impact"]) == ("Effective", "Ineffective")
    assert out["1174"]["price_forecast"] == 70.38


def test_null_lift_is_neutral(spark):
    df = spark.createDataFrame([(None,), (10.0,), (-10.0,), (10.1,)], "x double")
    assert [r[0] for r in df.select(impact_label(F.col("x"))).collect()] == ["Neutral", "Neutral", "Neutral", "Effective"]
    assert df.select(pct_change(F.col("x"), F.lit(5.0))).collect()[1][0] == 100.0


@pytest.fixture
def stores(spark):
    rows = [("P1", "A", 130, 100), ("P1", "B", 80, 100), ("P1", "C", 75, 100), ("P2", "A", 90, 100), ("P3", "A", 100, 100), (None, "A", 9, 1), (None, "B", 0, 5)]
    return spark.createDataFrame(rows, SCHEMA_INV)


def test_redistribution_uses_levels_before_any_move(stores):
    out = {(r["product_id"], r["store_id"]): r["stock_levels"] for r in redistributed_inventory(stores).collect()}
    assert out == {
        ("P1", "A"): 85, ("P1", "B"): 100, ("P1", "C"): 100, ("P2", "A"): 90, ("P3", "A"): 100, (None, "A"): 9, (None, "B"): 0,
    }
    assert rows_of(transfer_summary(stores), "product_id", "donors", "receivers", "pairs", "units_moved") == [("P1", 1, 2, 2, 45)]


def test_redistribution_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [
        ("HOT" if rng.random() < 0.5 else f"P{rng.randrange(9)}", f"S{i}", rng.randrange(20_000), rng.randrange(20_000)) for i in range(600)
    ]
    out = {r["store_id"]: r for r in redistribution(spark.createDataFrame(rows, SCHEMA_INV)).collect()}
    for product, store, stock, point in rows:
        given = taken = 0
        for other, _, s, p in rows:
            if other == product and stock > point and s < p:
                given += min(stock - point, p - s)
            if other == product and stock < point and s > p:
                taken += min(s - p, point - stock)
        assert (out[store]["units_given"], out[store]["units_taken"], out[store]["new_stock_levels"]) == (given, taken, stock - given + taken)
    assert sum(r["new_stock_levels"] for r in out.values()) == sum(r[2] for r in rows)


@pytest.mark.parametrize("lead,daily,safety,point", [(7, 10, 20, 90), (0, 10, 20, 20), (7, -5, 20, 20), (-1, 3, -4, 0)])
def test_reorder_point(spark, lead, daily, safety, point):
    assert spark.range(1).select(reorder_point(F.lit(lead), F.lit(daily), F.lit(safety))).first()[0] == point


def test_truncation_is_toward_zero(spark):
    assert spark.range(1).select(safety_stock(F.lit(14.9)), safety_stock(F.lit(-14.9))).first() == (2, -2)


def test_headings_and_defaults(spark):
    raw = spark.createDataFrame([("1", "2")], "` Product ID` string, `Store ID ` string")
    assert trim_headings(raw).columns == ["Product ID", "Store ID"]
    assert standard_names(raw).columns == ["product_id", "store_id"]
    full = with_defaults(spark.createDataFrame([("Rising",)], "demand_trend string")).first()
    assert (full["demand_trend"], full["weather_index"], full["promotion_budget"], full["seasonality_factors"]) == ("Rising", 100, 0, "None")


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1)], "x double, y long"))
    assert tuple(df.first()) == (None, 1)


def test_backfill(spark, inventory):
    f = spark.createDataFrame([("P1001", 3.0)], "product_id string, predicted_demand double")
    assert backfill_store(f, inventory).first()["store_id"] == "DEFAULT_STORE"
    assert backfill_store(f, inventory.where("store_id = 'S002'")).first()["store_id"] == "S002"
    assert backfill_store(f, inventory, first=True).first()["store_id"] == "S001"


def test_rejects(spark):
    df = spark.createDataFrame([("p", "s"), (None, "s"), ("p", " "), ("p", None)], "product_id string, store_id string")
    good, bad = split_rejects(df)
    assert good.count() == 1
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["empty product_id", "empty store_id", "empty store_id"]


def test_attach_refuses_repeated_keys(spark, inventory, forecast):
    assert attach_predictions(inventory, forecast).count() == 3
    with pytest.raises(Exception, match="duplicate prediction key"):
        attach_predictions(inventory, forecast.union(forecast)).collect()


def test_key_types_are_aligned(spark):
    left = spark.createDataFrame([(1, 2, 10)], "product_id int, store_id long, a int")
    right = spark.createDataFrame([("1", "2", 5)], "product_id string, store_id string, b int")
    assert rows_of(match(left, right), "a", "b") == [(10, 5)]
    assert match_suffixed(left, right.withColumnRenamed("b", "a"), ("_x", "_y")).columns[-2:] == ["a_x", "a_y"]


def test_matrix_refuses_repeated_keys(spark, inventory):
    assert sorted(rows_of(stock_matrix(inventory)))[0] == ("P1001", 50, None)
    with pytest.raises(Exception, match="duplicate product and store"):
        stock_matrix(inventory.union(inventory)).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    out = histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["items"] for r in out] == [2, 2, 2, 2, 3]
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert sum(r["items"] for r in histogram(same, "x", 4).collect()) == 2
    assert histogram(same.where("x is null"), "x", 4).count() == 0


def test_no_limit_on_levels_or_stores(spark):
    wide = spark.range(3000).selectExpr("'P' as product_id", "cast(id as string) as store_id", "id as stock_levels")
    assert len(level_list(wide, "store_id")) == 3000
    assert len(stock_maps(wide).first()["stock"]) == 3000
    with pytest.raises(Exception, match="(?i)duplicate"):
        stock_maps(wide.union(wide)).collect()
    vectors = segment_vector(wide.unionByName(wide.limit(1).withColumn("store_id", F.lit(None).cast("string"))), "store_id", "v")
    sizes = {(r["v"].size, r["v"].numNonzeros()) for r in vectors.collect()}
    assert sizes == {(3000, 1), (3000, 0)}


def test_rows_without_usable_keys_are_refused(spark, inventory, forecast):
    bad = spark.createDataFrame([("P1001", None, 5, 50, 1), ("P1002", " ", 5, 50, 1)], inventory.schema)
    lost = spark.createDataFrame([("P1003", None, 500.0)], forecast.schema)
    good = rows_of(reorder.reorder_suggestions(forecast, inventory))
    assert sorted(rows_of(reorder.reorder_suggestions(forecast.union(lost), inventory.union(bad)))) == sorted(good)
    assert reorder.reorder_suggestions(lost, inventory).count() == 0
    rejects = reorder.suggestion_rejects(forecast.union(lost), inventory.union(bad))
    assert sorted(rows_of(rejects, "table_name", "product_id")) == [("forecast", "P1003"), ("inventory", "P1001"), ("inventory", "P1002")]


def test_kpis_need_a_date_and_safety_counts(inventory, forecast):
    with pytest.raises(ValueError, match="as_of"):
        monitor.kpis(inventory)
    out = reorder.reorder_suggestions(forecast, inventory, safety=0.0)
    assert {r["safety_stock"] for r in out.collect()} == {0}


def test_profile_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(rows_of(profile(df))) == [("a", 2, 0), ("b", 2, 1)]
    assert rows_of(schema_report(df)) == [(0, "a", "int"), (1, "b", "string")]


def test_filters_and_shares(inventory):
    assert product_filter(inventory, "").count() == 3
    assert product_filter(inventory, "100[12]").count() == 2
    assert product_filter(inventory, "100[12]", literal=True).count() == 0
    assert {r["bucket"]: (r["items"], round(r["pct"], 3)) for r in shares(inventory, F.col("store_id")).collect()} == {"S001": (2, 66.667), "S002": (1, 33.333)}


def test_intents(spark):
    texts = ["Show UNDERSTOCKED items", "reorder plan", "demand next week", "hello", "understock reorder", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["intent"] for r in reports.intents(df).collect()] == ["understocked", "reorder", "forecast", "unknown", "understocked", "unknown"]


def test_digest(spark):
    df = spark.createDataFrame([(i, None if i == 2 else f"v{i}") for i in range(7, 0, -1)], "id int, name string")
    text = reports.digest({"Items": (df, ["id"])}).first()["digest"]
    assert text.split("\n") == ["### Items ###", "1. id: 1, name: v1", "2. id: 2", "3. id: 3, name: v3", "4. id: 4, name: v4", "5. id: 5, name: v5"]


def test_exploded_inventory_is_not_broadcast(spark, tmp_path):
    from checks.views import Views

    spark.range(1, 40).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5).selectExpr("int(id) as r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
    lines = spark.range(1, 60).selectExpr("id as product_id", "int(id % 5) as store_id", "1.0d as predicted_sales_quantity")
    joined = match(lines, Views(spark, str(tmp_path)).inventory)
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    expected = [i for i in range(1, 40) if (i + i % 5) % 7]
    assert sorted(r["product_id"] for r in joined.collect()) == expected
