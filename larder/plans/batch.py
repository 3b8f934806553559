"""The whole nightly run: demand or a forecast in, every report and the new stock table out."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.balance import redistributed_inventory
from larder.operators.columns import normal_forecast, stamped, tag
from larder.operators.windows import naive_forecast
from larder.plans.monitor import inventory_report, report_lines
from larder.plans.pricing import audit, overpriced, sales_impact, underpriced
from larder.plans.reorder import apply_reorders, by_urgency, reorder_log, reorder_suggestions, suggestion_rejects
from larder.schemas import KEYS
from larder.sources.files import path_exists, touch, write_dataset, write_report


def next_demand(demand: DataFrame, model: PipelineModel | None = None, prediction: str = "prediction") -> DataFrame:
    """Forecast per product and store: the prediction for its latest date.

    A fitted pipeline scores the rows; without one the mean of the last two days counts. ``demand`` is at daily
    grain.
    """
    if model is None:
        scored, prediction = naive_forecast(demand, KEYS, ["date"], daily_grain=True), "predicted_demand"
    else:
        scored = model.transform(demand)
    return scored.groupBy(*KEYS).agg(F.max_by(prediction, "date").alias("predicted_demand"))


def run_all(
    inventory: DataFrame,
    forecast: DataFrame | None,
    pricing: DataFrame,
    out: str,
    as_of: str,
    audit_threshold: float = 20,
    demand: DataFrame | None = None,
    model: PipelineModel | None = None,
    versions: dict[str, str] | None = None,
    on_step: Callable[[str], None] | None = None,
) -> dict[str, str]:
    """Write every report below ``out`` and return their paths.

    The first step is the forecast: of ``demand`` by ``model`` (or the naive mean), unless a finished
    ``forecast`` with predicted_sales_quantity or predicted_demand per product and store is
    given. Forecast and suggestions are written first and read back by the steps that build
    on them. Rows refused for their keys are written too. A run replaces what an earlier run of
    the same ``as_of`` has written, its rows of the log included.

    ``versions`` names the versions of the inputs and makes a run resumable: finished steps are marked below ``out``, and
    a run of the same ``as_of`` and versions goes on at the first step that is not. With other versions all steps are run.
    """
    spark = inventory.sparkSession
    paths = {
        name: f"{out}/{name}"
        for name in (
            "forecast", "inventory_report", "reorder_suggestions", "rejected_rows", "reorder_log", "overpriced", "underpriced", "sales_impact",
            "inventory_audit", "processed_reorders", "rejected_reorders", "updated_inventory", "redistributed_inventory",
        )
    }
    if forecast is None:
        if demand is None:
            raise ValueError("run_all needs a forecast or demand to forecast from")
        forecast = next_demand(demand, model)
    log = f"{paths['reorder_log']}/run={re.sub('[^0-9A-Za-z]+', '-', as_of)}"

    def predicted() -> DataFrame:
        return spark.read.parquet(paths["forecast"])

    def as_sales() -> DataFrame:
        return predicted().withColumnRenamed("predicted_demand", "predicted_sales_quantity").select(*KEYS, "predicted_sales_quantity")

    def suggestions() -> DataFrame:
        return spark.read.parquet(paths["reorder_suggestions"])

    def applied(nth: int) -> DataFrame:
        return apply_reorders(suggestions(), inventory, as_of)[nth]

    steps: dict[str, Callable[[], None]] = {
        "forecast": lambda: write_dataset(normal_forecast(forecast), paths["forecast"]),
        "inventory_report": lambda: write_report(report_lines(inventory_report(inventory, as_of)), paths["inventory_report"]),
        "reorder_suggestions": lambda: write_dataset(by_urgency(reorder_suggestions(predicted(), inventory)), paths["reorder_suggestions"]),
        "rejected_rows": lambda: write_dataset(suggestion_rejects(predicted(), inventory), paths["rejected_rows"]),
        "reorder_log": lambda: write_dataset(reorder_log(suggestions(), as_of), log),
        "overpriced": lambda: write_dataset(overpriced(pricing), paths["overpriced"]),
        "underpriced": lambda: write_dataset(underpriced(pricing), paths["underpriced"]),
        "sales_impact": lambda: write_dataset(sales_impact(pricing, as_sales()), paths["sales_impact"]),
        "inventory_audit": lambda: write_dataset(audit(inventory, as_sales(), audit_threshold), paths["inventory_audit"]),
        "processed_reorders": lambda: write_dataset(applied(1), paths["processed_reorders"]),
        "rejected_reorders": lambda: write_dataset(tag(applied(2), rejected_at=stamped(as_of)), paths["rejected_reorders"]),
        "updated_inventory": lambda: write_dataset(applied(0), paths["updated_inventory"]),
        "redistributed_inventory": lambda: write_dataset(redistributed_inventory(inventory), paths["redistributed_inventory"]),
    }
    state = hashlib.sha256(json.dumps([as_of, sorted((versions or {}).items())]).encode()).hexdigest()[:16]
    behind = versions is not None  # still passing over what an earlier run has finished
    for name, write in steps.items():
        mark = f"{out}/_finished/{state}/{name}"
        behind = behind and path_exists(spark, mark)
        if behind:
            continue
        write()
        if versions is not None:
            touch(spark, mark)
        if on_step:
            on_step(name)
    return paths
