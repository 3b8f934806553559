import shutil

import pytest
from conftest import SCHEMA_INV, rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.matching import match
from larder.plans.batch import run_all
from larder.schemas import INVENTORY, SUGGESTIONS
from larder.sources import files
from larder.sources.files import append_dataset, read_csv, read_csv_checked, read_dataset, read_log, write_dataset, write_report
from larder.sources.tables import Dataset, Registry, VersionedTable, load_table, save_bucketed, scan_table

CSV = """Product ID, Store ID ,Stock Levels,Supplier Lead Time (days),Stockout Frequency,Reorder Point,Expiry Date,Warehouse Capacity,Order Fulfillment Time (days)
7001,81,340,12,5,44,2024-03-09,900,2
7002,82,12.0,9,3,71,soon,650,
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "inventory.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_by_heading(spark, csv_path):
    df = read_csv(spark, csv_path, INVENTORY)
    assert df.schema == INVENTORY
    rows = {r["product_id"]: r for r in df.collect()}
    assert rows["7001"]["reorder_point"] == 44 and str(rows["7001"]["expiry_date"]) == "2024-03-09"
    assert rows["7002"]["stock_levels"] == 12 and rows["7002"]["expiry_date"] is None and rows["7002"]["fulfillment_days"] is None


def test_missing_files(spark, tmp_path):
    gone = str(tmp_path / "gone.csv")
    assert read_dataset(spark, gone, INVENTORY, on_missing="empty").count() == 0
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, gone, INVENTORY)
    with pytest.raises(ValueError):
        read_dataset(spark, gone, INVENTORY, on_missing="maybe")


def test_sinks(spark, tmp_path, inventory):
    out = str(tmp_path / "out")
    write_dataset(inventory, out, partition_by=["store_id"])
    write_dataset(inventory, out, partition_by=["store_id"])
    assert read_dataset(spark, out, inventory.schema, kind="parquet").count() == 3
    write_dataset(inventory, str(tmp_path / "c"), kind="csv")
    back = read_csv(spark, str(tmp_path / "c"), INVENTORY).select(*inventory.columns)
    assert sorted(rows_of(back)) == sorted(rows_of(inventory))
    log = str(tmp_path / "log")
    append_dataset(inventory.drop("lead_time_days"), log)
    append_dataset(inventory, log)
    assert read_log(spark, log).where("lead_time_days is null").count() == 3
    write_report(inventory.selectExpr("product_id as value"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 3


def test_files_of_a_folder_may_order_their_columns_differently(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("Product ID,Store ID,Stock Levels,Reorder Point\nP1,S1,5,50\n")
    (folder / "b.csv").write_text("Reorder Point,Stock Levels,Store ID,Product ID\n50,5,S1,P2\n")
    (folder / "c.csv").write_text("product_id,store_id,reorder_point\nP3,S1,50\n")
    (folder / "d.csv").write_text("")
    rows = read_csv(spark, str(folder), INVENTORY).select("product_id", "stock_levels", "reorder_point")
    assert sorted(rows_of(rows)) == [("P1", 5, 50), ("P2", 5, 50), ("P3", None, 50)]


def test_versions_survive_a_dead_writer_and_two_writers(spark, tmp_path, inventory):
    table = VersionedTable(spark, str(tmp_path / "stock"), inventory.schema)
    table.write(inventory)
    inventory.write.parquet(str(tmp_path / "stock" / "v=2"))
    (tmp_path / "stock" / "v=2" / "_SUCCESS").unlink()  # a write that died half-way, as earlier releases left it
    (tmp_path / "stock" / "_writing-dead").mkdir()
    assert table.version() == 1 and table.update(lambda df: df) == 3 and table.read().count() == 3
    other = VersionedTable(spark, str(tmp_path / "stock"), inventory.schema)
    assert table.write(inventory, version=4) == 4
    with pytest.raises(Exception, match="(?i)exists"):
        other.write(inventory.limit(1), version=4)
    assert other.read().count() == 3


def test_sql_tables(spark, csv_path):
    load_table(spark, csv_path, INVENTORY, "inventory_view")
    assert scan_table(spark, "inventory_view").count() == 2
    load_table(spark, csv_path, INVENTORY, "inventory_managed", managed=True)
    load_table(spark, csv_path, INVENTORY, "inventory_managed", managed=True)
    assert spark.sql("select * from inventory_managed").count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark, inventory, forecast):
    stock = save_bucketed(inventory, "stock_bucketed", 4)
    demand = save_bucketed(forecast, "demand_bucketed", 4)
    joined = match(demand.hint("merge"), stock)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 3


def test_versioned_rewrite(spark, tmp_path, inventory):
    table = VersionedTable(spark, str(tmp_path / "stock"), inventory.schema)
    assert table.read().count() == 0
    table.write(inventory)
    table.update(lambda df: df.selectExpr("product_id", "store_id", "stock_levels + 1 as stock_levels", "reorder_point", "lead_time_days"))
    assert table.version() == 2
    assert sorted(rows_of(table.read(), "stock_levels")) == [(11,), (51,), (76,)]
    assert sorted(rows_of(table.read(1), "stock_levels")) == [(10,), (50,), (75,)]
    with pytest.raises(Exception, match="(?i)exists"):
        table.write(inventory, version=2)


def test_registry_cache_expires(spark, tmp_path, inventory):
    path, now = str(tmp_path / "inv"), [0.0]
    inventory.write.parquet(path)
    reg = Registry(
        spark,
        {"inventory": Dataset(path, inventory.schema), "reorders": Dataset(str(tmp_path / "none"), SUGGESTIONS)},
        clock=lambda: now[0],
    )
    assert {n: df.count() for n, df in reg.load_all().items()} == {"inventory": 3, "reorders": 0}
    first = reg.cached("inventory")
    assert first.count() == 3 and reg.cached("inventory") is first
    # another writer adds a file; a write of this session would refresh the cache at once
    inventory.coalesce(1).write.parquet(str(tmp_path / "more"))
    for file in (tmp_path / "more").glob("part-*.parquet"):
        shutil.copy(file, tmp_path / "inv" / f"more-{file.name}")
    now[0] = 299.0
    assert reg.cached("inventory").count() == 3
    now[0] = 300.0
    assert reg.cached("inventory").count() == 6
    reg.register_views()
    assert spark.table("inventory").count() == 6


def test_whole_run(spark, tmp_path, forecast):
    inv = spark.createDataFrame(
        [("P1001", "S001", 50, 30, 7, "2024-07-01", 15), ("P1002", "S001", 10, 20, 5, "2025-01-01", 80), ("P1002", "S002", 90, 20, 5, "2025-01-01", 80)],
        SCHEMA_INV + ", lead_time_days int, expiry_date string, warehouse_capacity long",
    ).selectExpr("* except(expiry_date)", "cast(expiry_date as date) as expiry_date")
    prices = spark.createDataFrame([("P1001", "S001", 100.0, 80.0, 50.0)], "product_id string, store_id string, price double, competitor_prices double, sales_volume double")
    out = str(tmp_path / "run")
    paths = run_all(inv, forecast, prices, out, "2024-06-30 06:00:00")
    paths = run_all(inv, forecast, prices, out, "2024-07-01 06:00:00")
    read = lambda name: spark.read.parquet(paths[name])
    assert sorted(r[0] for r in spark.read.text(paths["inventory_report"]).collect())[2] == "Stockout risk: 1 items"
    assert rows_of(read("reorder_suggestions"), "product_id", "reorder_qty") == [("P1002", 20), ("P1001", 22)]
    assert read("reorder_log").count() == 4
    assert read("overpriced").count() == 1 and read("underpriced").count() == 0
    assert rows_of(read("sales_impact"), "impact") == [("Ineffective",)]
    assert read("inventory_audit").count() == 0
    assert read("processed_reorders").count() == 2 and read("rejected_reorders").count() == 0
    assert sorted(rows_of(read("updated_inventory"), "stock_levels")) == [(30,), (72,), (90,)]
    assert sorted(rows_of(read("redistributed_inventory"), "stock_levels")) == [(20,), (50,), (80,)]
    run_all(inv, forecast, prices, out, "2024-07-01 06:00:00")
    assert read("reorder_log").count() == 4  # a rerun of the same night replaces its rows


def test_whole_run_begins_with_a_forecast(spark, tmp_path, inventory):
    days = [("P1001", "S001", f"2024-06-{d:02d}", 50.0 + 10 * d) for d in (1, 2)] + [("P1002", None, "2024-06-01", 70.0)]
    demand = spark.createDataFrame(days, "product_id string, store_id string, date string, sales_quantity double").withColumn("date", F.to_date("date"))
    inv = inventory.withColumns({"expiry_date": F.to_date(F.lit("2025-01-01")), "warehouse_capacity": F.lit(90)})
    prices = spark.createDataFrame([], "product_id string, store_id string, price double, competitor_prices double, sales_volume double")
    paths = run_all(inv, None, prices, str(tmp_path / "run"), "2024-06-03 06:00:00", demand=demand)
    read = lambda name: spark.read.parquet(paths[name])
    assert sorted(rows_of(read("forecast"), "product_id", "predicted_demand")) == [("P1001", 65.0), ("P1002", 70.0)]
    assert rows_of(read("reorder_suggestions"), "product_id") == [("P1001",)]
    assert rows_of(read("rejected_rows"), "table_name", "reject_reason") == [("forecast", "empty store_id")]
    with pytest.raises(ValueError, match="forecast"):
        run_all(inv, None, prices, str(tmp_path / "no"), "2024-06-03")


def test_broken_run_goes_on_at_the_first_unfinished_step(spark, tmp_path, inventory, forecast):
    inv = inventory.withColumns({"expiry_date": F.to_date(F.lit("2025-01-01")), "warehouse_capacity": F.lit(90)})
    prices = spark.createDataFrame([("P1001", "S001", 100.0, 80.0, 50.0)], "product_id string, store_id string, price double, competitor_prices double, sales_volume double")
    done, out = [], str(tmp_path / "run")

    def breaks(name):
        done.append(name)
        if name == "sales_impact" and len(done) < 10:
            raise KeyboardInterrupt

    run = lambda **v: run_all(inv, forecast, prices, out, "2024-07-01 06:00:00", versions=v, on_step=breaks)
    with pytest.raises(KeyboardInterrupt):
        run(stock="v=3")
    paths = run(stock="v=3")
    assert len(done) == len(set(done)) == len(paths) and list(paths)[8] == done[8] == "inventory_audit"
    assert spark.read.parquet(paths["updated_inventory"]).count() == 3 and spark.read.parquet(paths["reorder_log"]).count() == 2
    run(stock="v=3")
    assert len(done) == len(paths)  # all is finished
    run(stock="v=4")
    assert len(done) == 2 * len(paths)  # other inputs: everything anew


NOTES = T.StructType().add("product_id", "string").add("product_name", "string").add("stock_levels", "long").add("expiry_date", "date")


def test_quoted_line_breaks_are_one_value(spark, tmp_path):
    (tmp_path / "a.csv").write_text('product_id,product_name,stock_levels\nP1,"two\nlines, and ""quotes""",3\nP2,plain,4\n')
    rows = rows_of(read_csv(spark, str(tmp_path), NOTES))
    assert sorted(rows) == [("P1", 'two\nlines, and "quotes"', 3, None), ("P2", "plain", 4, None)]


def test_bad_rows_go_to_the_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('product_id,product_name,stock_levels,expiry_date\nP1,"a\nb",3,2024-01-02\nP2,x,4,2024-01-02,more\nP3,x\nP4,x,many,\n')
    (tmp_path / "b.csv").write_text("stock_levels, product_id ,other\n5,P5,z\n,P6,z\nNaN7,P7,z\n")
    (tmp_path / "c.csv").write_text("")
    rows, rejects = read_csv_checked(spark, str(tmp_path), NOTES)
    assert sorted(r["product_id"] for r in rows.collect()) == ["P1", "P5", "P6"]
    found = sorted((r["file"].rsplit("/", 1)[1], r["reason"], r["line"][:2]) for r in rejects.collect())
    assert found == [
        ("a.csv", "number of fields", "P2"), ("a.csv", "number of fields", "P3"), ("a.csv", "stock_levels is no bigint", "P4"), ("b.csv", "stock_levels is no bigint", "Na"),
    ]
    none, no_rejects = read_csv_checked(spark, str(tmp_path / "c.csv"), NOTES)
    assert none.count() == 0 == no_rejects.count() and none.schema.names == NOTES.names


def test_headings_of_many_files_are_found_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HEADINGS_ON_DRIVER", 3)
    for i in range(60):
        head, row = ("product_id,stock_levels", f"P{i},{i}") if i % 2 else ("stock_levels,product_id", f"{i},P{i}")
        (tmp_path / f"{i}.csv").write_text(f"{head}\n{row}\n")
    rows, rejects = read_csv_checked(spark, str(tmp_path), NOTES)
    assert sorted(rows_of(rows, "stock_levels", "product_id")) == [(i, f"P{i}") for i in range(60)] and rejects.count() == 0
    assert sorted(rows_of(read_csv(spark, str(tmp_path), NOTES), "stock_levels", "product_id")) == [(i, f"P{i}") for i in range(60)]
