import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from larder.operators.ledger import adjust, closing_stock, settle

COLUMNS = "event_id long, t long, product_id string, store_id string, qty long, tx_type string"


def movements(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def stock_of(spark, levels):
    return spark.createDataFrame([(p, "A", n) for p, n in levels.items()], "product_id string, store_id string, stock_levels long")


def replay(rows, levels):
    levels, out = dict(levels), {}
    for event, _, product, _, qty, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if product not in levels:
            out[event] = (False, None)
            continue
        ok = kind == "RESTOCK" or qty <= levels[product]
        if ok:
            levels[product] += qty if kind == "RESTOCK" else -qty
        out[event] = (ok, levels[product])
    return out, levels


def test_refused_sale_does_not_count(spark):
    rows = [
        (1, 1, "P1", "A", 4, "SALE"), (2, 2, "P1", "A", 7, "SALE"), (3, 3, "P1", "A", 5, "RESTOCK"),
        (4, 4, "P1", "A", 7, "SALE"), (5, 5, "P9", "A", 1, "SALE"), (6, 6, "P1", " ", 1, "SALE"),
        (7, 7, "P1", "A", None, "SALE"), (8, 8, "P1", "A", 1, "GIFT"),
    ]
    stock = stock_of(spark, {"P1": 10})
    log = settle(movements(spark, rows), stock)
    assert sorted(rows_of(log, "event_id", "accepted", "stock_after", "reason")) == [
        (1, True, 6, None), (2, False, 6, "not enough stock"), (3, True, 11, None), (4, True, 4, None),
        (5, False, None, "unknown product and store"), (6, False, None, "invalid store id"),
        (7, False, 10, "invalid quantity"), (8, False, 10, "unknown type"),
    ]
    assert rows_of(closing_stock(stock, log), "product_id", "stock_levels") == [("P1", 4)]


@pytest.mark.parametrize("sale_share,hot_level,seed", [(0.55, 100, 1), (0.5, 0, 2), (0.3, 5, 3), (0.9, 4000, 4), (0.5, 30, 5)])
def test_hot_key_over_several_ranges_equals_replay(spark, many_ranges, sale_share, hot_level, seed):
    rng = random.Random(seed)
    rows = [
        (i, rng.randrange(500), "HOT" if rng.random() < 0.7 else f"P{rng.randrange(12)}", "A", rng.randint(1, 30),
         "SALE" if rng.random() < sale_share else "RESTOCK")
        for i in range(3000)
    ]
    levels = {"HOT": hot_level} | {f"P{i}": 7 * i for i in range(11)}
    expected, closing = replay(rows, levels)
    stock = stock_of(spark, levels)
    log = settle(movements(spark, rows).repartition(3), stock)
    got = {r["event_id"]: (r["accepted"], r["stock_after"]) for r in log.collect()}
    assert got == expected
    assert all(level is None or level >= 0 for _, level in got.values())
    assert dict(rows_of(closing_stock(stock, log), "product_id", "stock_levels")) == closing


def test_empty_movements(spark):
    assert settle(movements(spark, []), stock_of(spark, {"P1": 1})).count() == 0


def test_adjustments_have_no_stock_check(spark):
    stock = stock_of(spark, {"P1": 3})
    changes = spark.createDataFrame([("P1", "A", -5), ("P1", "A", 1), ("P2", "A", 4)], "product_id string, store_id string, amount long")
    after, rejected = adjust(stock, changes)
    assert rows_of(after) == [("P1", "A", -1)]
    assert rows_of(rejected, "product_id", "amount") == [("P2", 4)]


def test_repeated_stock_keys_are_an_error(spark):
    stock = stock_of(spark, {"P1": 5}).union(stock_of(spark, {"P1": 9}))
    with pytest.raises(Exception, match="duplicate product and store"):
        settle(movements(spark, [(1, 1, "P1", "A", 7, "SALE")]), stock).collect()
