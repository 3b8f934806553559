"""A slice of the checked queries against DuckDB, on the smallest driver tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from checks.catalog import load  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
SLICE = [
    "report_counts",
    "reorder_suggestions",
    "join_product_fallback",
    "applied_stock",
    "redistributed_stock",
    "transfer_summary",
    "price_flags",
    "sales_impact",
    "holiday_flags",
    "rolling_means_long_series",
    "seasonal_decomposition",
    "expanding_folds",
    "price_quantiles",
    "demand_features",
    "evaluation",
    "movement_log",
    "report_digest",
]

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return repr(x)


def test_every_sql_runs_and_names_are_plain(duck):
    catalog = load()
    for name, q in catalog.items():
        assert not name.startswith("op") and "pipeline" not in name
        if q.sql:
            duck.execute(f"describe {q.sql}")


@pytest.mark.parametrize("name", SLICE)
def test_spark_equals_sql(spark, duck, name):
    q = load()[name]
    df = q.run(spark, str(FOLDER))
    columns = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(q.sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    assert ours == theirs
