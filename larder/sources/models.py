"""Saved forecast models: the fitted stages and the settings they were fitted with."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from larder.sources.files import path_exists


def save_model(model: PipelineModel, path: str, settings: dict, spark: SparkSession) -> None:
    """Write the stages and a one-line JSON with settings (levels, price cut, blend)."""
    model.write().overwrite().save(f"{path}/stages")
    line = spark.createDataFrame([(json.dumps(settings),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    if not path_exists(spark, f"{path}/stages"):
        raise FileNotFoundError(path)
    settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    return PipelineModel.load(f"{path}/stages"), settings
