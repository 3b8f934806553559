import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from larder.session import local_session  # noqa: E402

SCHEMA_INV = "product_id string, store_id string, stock_levels long, reorder_point long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        4,
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(shared),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def many_ranges(spark):
    """Keep small test tables in several ranges, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture
def inventory(spark):
    rows = [("P1001", "S001", 50, 30, 7), ("P1002", "S001", 10, 20, 5), ("P1003", "S002", 75, 50, 3)]
    return spark.createDataFrame(rows, SCHEMA_INV + ", lead_time_days int")


@pytest.fixture
def forecast(spark):
    rows = [("P1001", "S001", 60.0), ("P1002", "S001", 25.0), ("P1003", "S002", 50.0)]
    return spark.createDataFrame(rows, "product_id string, store_id string, predicted_demand double")


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]
