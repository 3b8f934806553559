import random
import time
from pathlib import Path

import pytest
from conftest import rows_of
from test_ledger import movements, replay, stock_of

from larder.operators.ledger import settle
from larder.plans.monitor import kpis
from larder.schemas import KEYS, MOVEMENTS
from larder.sources.tables import VersionedTable
from larder.session import clear_staged, stage, staged_dir
from larder.streaming.movements import HEARTBEAT, REFRESH, append_log, keyed_ledger, kpis_after, movement_source, settle_batches, stock_after

ROWS = [
    (1, 10, "P1", "A", 4, "SALE"), (2, 11, "P2", "A", 1, "SALE"), (3, 12, "P1", "A", 7, "SALE"), (4, 13, "P9", "A", 1, "SALE"),
    (5, 20, "P1", "A", 5, "RESTOCK"), (6, 21, "P1", "A", 7, "SALE"), (7, 22, "P2", "A", 9, "SALE"), (8, 23, "P2", "A", 3, "RESTOCK"),
]
LEVELS = {"P1": 10, "P2": 5}


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "events")
    for part in (ROWS[:4], ROWS[4:]):
        movements(spark, part).select(*MOVEMENTS.names).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("merge_every", [1, 2, 20])
def test_batches_settle_like_one_replay(spark, tmp_path, folder, merge_every):
    stock = stock_of(spark, LEVELS).selectExpr("*", "8 as reorder_point")
    table = VersionedTable(spark, str(tmp_path / "stock"), stock.schema)
    table.write(stock, version=0)
    forecast = spark.createDataFrame([("P1", "A", 20.0), ("P2", "A", 1.0)], "product_id string, store_id string, predicted_demand double")
    seen = []
    query = settle_batches(
        movement_source(spark, folder, files_per_batch=1), table, str(tmp_path / "log"), str(tmp_path / "check"),
        forecast, str(tmp_path / "orders"), on_batch=seen.append, merge_every=merge_every,
    )
    assert query.awaitTermination(120)
    assert query.exception() is None
    assert seen == [0, 1]
    log = spark.read.parquet(str(tmp_path / "log"))
    expected, closing = replay(ROWS, LEVELS)
    assert {r["event_id"]: (r["accepted"], r["stock_after"]) for r in log.collect()} == expected
    assert dict(rows_of(stock_after(table, 2, merge_every), "product_id", "stock_levels")) == closing
    assert table.version() == 2 // merge_every
    assert log.where("late").count() == 0
    orders = spark.read.parquet(str(tmp_path / "orders"))
    last = orders.where("batch = 1")
    assert sorted(rows_of(last, "product_id", "stock_levels", "reorder_qty")) == [("P1", 4, 20), ("P2", 7, 0)]


def streamed(spark, tmp_path, parts, levels, delay="10 minutes"):
    """Log of ``keyed_ledger`` over one file per part, after a heartbeat far ahead."""
    path, log = str(tmp_path / "events"), str(tmp_path / "log")
    for part in (*parts, [(None, 10**7, None, None, None, HEARTBEAT)]):
        movements(spark, part).select(*MOVEMENTS.names).coalesce(1).write.mode("append").parquet(path)
    query = append_log(keyed_ledger(movement_source(spark, path, 1), stock_of(spark, levels), delay), log, str(tmp_path / "check"))
    assert query.awaitTermination(300) and query.exception() is None
    return spark.read.parquet(log)


def test_keyed_state_settles_like_one_replay(spark, tmp_path):
    out = streamed(spark, tmp_path, [ROWS[:4], ROWS[4:]], LEVELS)
    expected, _ = replay(ROWS, LEVELS)
    assert {r["event_id"]: (r["accepted"], r["stock_after"]) for r in out.collect()} == expected
    assert out.where("late").count() == 0 and set(KEYS) <= set(out.columns)
    reasons = dict(rows_of(out.where("not accepted"), "event_id", "reason"))
    assert reasons[4] == "unknown product and store" and reasons[3] == "not enough stock"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_watermark_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(500), f"P{rng.randrange(4)}", "A", rng.randrange(1, 9), rng.choice(["SALE", "SALE", "RESTOCK"])) for i in range(400)]
    rng.shuffle(rows)
    levels = {f"P{k}": 10 for k in range(3)}
    out = streamed(spark, tmp_path, [rows[i::4] for i in range(4)], levels)
    batch = settle(movements(spark, rows), stock_of(spark, levels))
    picked = ["event_id", "accepted", "reason", "stock_after"]
    assert sorted(map(repr, rows_of(out, *picked))) == sorted(map(repr, rows_of(batch, *picked)))
    assert out.where("late").count() == 0 and any(not r["accepted"] for r in out.collect())


def test_fifty_thousand_movements_of_one_key_in_reverse(spark, tmp_path):
    rows = spark.range(50_000).selectExpr(
        "id as event_id", "timestamp_seconds(50000 - id) as ts", "'P1' as product_id", "'A' as store_id", "cast(id % 7 + 1 as long) as qty",
        "if(id % 3 = 0, 'RESTOCK', 'SALE') as tx_type",
    )
    path, log = str(tmp_path / "events"), str(tmp_path / "log")
    rows.select(*MOVEMENTS.names).coalesce(1).write.parquet(path)
    movements(spark, [(None, 10**7, None, None, None, HEARTBEAT)]).select(*MOVEMENTS.names).coalesce(1).write.mode("append").parquet(path)
    query = append_log(keyed_ledger(movement_source(spark, path, 1), stock_of(spark, {"P1": 5}), "1 day"), log, str(tmp_path / "check"))
    assert query.awaitTermination(300) and query.exception() is None
    out, batch = spark.read.parquet(log), settle(rows, stock_of(spark, {"P1": 5}))
    picked = ["event_id", "accepted", "stock_after"]
    assert out.count() == 50_000 and out.where("late").count() == 0
    assert out.select(*picked).exceptAll(batch.select(*picked)).count() == 0


def test_movement_behind_the_watermark_is_applied_and_marked(spark, tmp_path):
    # the second part moves the watermark past the first movement, the third lets it out, the fourth comes too late
    parts = [[(1, 5000, "P1", "A", 4, "SALE")], [(2, 9000, "P2", "A", 1, "SALE")], [(5, 9050, "P2", "A", 1, "SALE")]]
    parts.append([(3, 10, "P1", "A", 5, "SALE"), (4, 9100, "P1", "A", 2, "SALE")])
    out = {r["event_id"]: (r["stock_after"], r["late"]) for r in streamed(spark, tmp_path, parts, LEVELS, "1 minute").collect()}
    assert out == {1: (6, False), 2: (4, False), 5: (3, False), 3: (1, True), 4: (1, False)}


def test_blank_unknown_and_null_movements_are_refused(spark, tmp_path):
    rows = [
        (1, 1, "P1", " ", 1, "SALE"), (2, 2, "P1", "A", None, "SALE"), (3, 3, "P1", "A", 1, "GIFT"), (4, 4, "P1", "A", 1, None),
        (5, 5, None, "A", 1, "SALE"), (6, 6, "P1", None, 1, "SALE"), (None, 7, "P1", "A", 1, "SALE"),
    ]
    out = {r["event_id"]: (r["reason"], r["stock_after"]) for r in streamed(spark, tmp_path, [rows], LEVELS).collect()}
    assert out == {
        1: ("invalid store id", None), 2: ("invalid quantity", 10), 3: ("unknown type", 10), 4: ("unknown type", 10),
        5: ("unknown product and store", None), 6: ("invalid store id", None), None: (None, 9),
    }


@pytest.mark.parametrize("merge_every", [1, 20])
def test_batches_mark_late_movements_too(spark, tmp_path, merge_every):
    path = str(tmp_path / "events")
    for part in ([(1, 50, "P1", "A", 4, "SALE")], [(2, 10, "P1", "A", 5, "SALE"), (3, 11, "P2", "A", 1, "SALE")]):
        movements(spark, part).select(*MOVEMENTS.names).coalesce(1).write.mode("append").parquet(path)
    table = VersionedTable(spark, str(tmp_path / "stock"), stock_of(spark, LEVELS).schema)
    table.write(stock_of(spark, LEVELS), version=0)
    query = settle_batches(movement_source(spark, path, 1), table, str(tmp_path / "log"), str(tmp_path / "check"), merge_every=merge_every)
    assert query.awaitTermination(120) and query.exception() is None
    assert sorted(rows_of(spark.read.parquet(str(tmp_path / "log")), "event_id", "late")) == [(1, False), (2, True), (3, False)]


def batches_of(spark, tmp_path, parts, **options):
    path = str(tmp_path / "events")
    for part in parts:
        movements(spark, part).select(*MOVEMENTS.names).coalesce(1).write.mode("append").parquet(path)
    there = tmp_path / "stock" / "v=0"
    schema = spark.read.parquet(str(there)).schema if there.exists() else stock_of(spark, LEVELS).schema
    table = VersionedTable(spark, str(tmp_path / "stock"), schema)
    if table.version() is None:
        table.write(stock_of(spark, LEVELS), version=0)
    return table, settle_batches(movement_source(spark, path, 1), table, str(tmp_path / "log"), str(tmp_path / "check"), **options)


def test_foreign_version_between_two_merges_stops_the_stream_and_stays(spark, tmp_path):
    seen = []

    def meddle(batch):
        seen.append(batch)
        if batch == 0:
            table.update(lambda df: df.withColumn("stock_levels", df.stock_levels + 1000))

    parts = [[(i, i, "P1", "A", 1, "SALE")] for i in range(4)]
    table = VersionedTable(spark, str(tmp_path / "stock"), stock_of(spark, LEVELS).schema)
    _, query = batches_of(spark, tmp_path, parts, on_batch=meddle, merge_every=2)
    with pytest.raises(Exception, match="another writer"):
        query.awaitTermination(120)
    assert seen == [0] and dict(rows_of(table.read(), "product_id", "stock_levels")) == {"P1": 1010, "P2": 1005}


def test_merge_that_is_run_again_counts_once(spark, tmp_path):
    def breaks(batch):
        if batch == 1 and not again:
            again.append(batch)
            raise ValueError("after the merge")

    again = []
    parts = [[(i, i, "P1", "A", 1, "SALE")] for i in range(4)]
    _, query = batches_of(spark, tmp_path, parts, on_batch=breaks, merge_every=2)
    with pytest.raises(Exception, match="after the merge"):
        query.awaitTermination(120)
    table, query = batches_of(spark, tmp_path, [], on_batch=breaks, merge_every=2)
    assert query.awaitTermination(120) and query.exception() is None
    assert dict(rows_of(table.read(2), "product_id", "stock_levels")) == {"P1": 6, "P2": 5}


def test_old_versions_and_changes_are_removed(spark, tmp_path):
    table, query = batches_of(spark, tmp_path, [[(i, i, "P1", "A", 1, "SALE")] for i in range(7)], merge_every=2, keep=2)
    assert query.awaitTermination(120) and query.exception() is None
    names = lambda p: sorted(x.name for x in (tmp_path / "stock" / p).iterdir())
    assert [n for n in names("") if n.startswith("v=")] == ["v=2", "v=3"]
    assert names("newest") == ["v=2", "v=3"] and names("changes") == ["batch=4", "batch=5", "batch=6"]
    assert dict(rows_of(stock_after(table, 7, 2), "product_id", "stock_levels")) == {"P1": 3, "P2": 5}


def test_kept_kpis_equal_those_of_the_whole_table(spark, tmp_path):
    stock = spark.range(40).selectExpr(
        "concat('P', id) as product_id", "'A' as store_id", "id % 9 as stock_levels", "5L as reorder_point", "date_add(date'2024-01-01', cast(id as int) * 3) as expiry_date",
        "id % 15 as warehouse_capacity",
    )
    table = VersionedTable(spark, str(tmp_path / "stock"), stock.schema)
    table.write(stock, version=0)
    rng = random.Random(4)
    parts = [[(100 * b + i, 100 * b + i, f"P{rng.randrange(50)}", "A", rng.randrange(1, 7), rng.choice(["SALE", "RESTOCK"])) for i in range(15)] for b in range(3)]
    seen = []

    def compare(batch):
        whole = kpis(stock_after(table, batch + 1, 2), as_of="2024-02-01").collect()
        seen.append(kpis_after(table, batch + 1).select(*whole[0].asDict()).collect() == whole)

    _, query = batches_of(spark, tmp_path, parts, on_batch=compare, merge_every=2, keep=2, kpis_as_of="2024-02-01")
    assert query.awaitTermination(200) and query.exception() is None and seen == [True] * 3


def test_refresh_interval_fires_again_and_again(spark, tmp_path):
    assert REFRESH == {"processingTime": "5 minutes"}
    parts = [[(i, i, "P1", "A", 1, "SALE")] for i in range(3)]
    seen = []
    _, query = batches_of(spark, tmp_path, parts, trigger=dict.fromkeys(REFRESH, "1 second"), on_batch=seen.append)
    try:
        for _ in range(300):
            if len(seen) == 3:
                break
            time.sleep(0.2)
        assert seen == [0, 1, 2] and query.isActive
    finally:
        query.stop()


def test_staged_folders_of_an_application_are_removed(spark):
    kept = stage(spark.range(3), "tidy")
    assert kept.count() == 3
    clear_staged(spark)
    assert not Path(staged_dir(spark).removeprefix("file:")).exists()
