"""Corpus pipeline: quality, near duplicates, benchmark leaks, source mix and shards, over ``documents``.

Each stage takes what the one before kept and returns the columns of documents; the last adds
shard and slot. Stages work on all rows they get:

* ``quality``: documents scored under 0.5 go; learned as in op8.
* ``near_duplicates``: of each group of texts linked by 5-word shingles at 0.8 or more, the smallest
  doc_id stays (one row of it). A doc_id that stands for several texts is a document for each of them, so it
  ties no groups together; a row without doc_id is a document of its text and stays only in groups of such rows
  (ids and texts are told apart by a 64-bit hash of both). Null and empty texts are linked with nothing.
* ``decontaminate``: documents that hold a copy of a benchmark item go.
* ``mix``: documents are repeated by a Poisson draw at the rate of their source. A repeated row
  has the same doc_id as the first.
* ``shard``: 40 shards of nearly equal bytes; repeated rows are numbered and spread like others.

Stages carry other columns, whatever their names (the last replaces ``shard`` and ``slot``), read texts of any length whole,
and give an empty result on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import benchmark, jaccard, mixing, quality, sharding
from larder.llm.queries import SHARDS, fold_of
from larder.llm.shared import column, stage, table

ORACLE_SQL = None  # learned scores have no SQL; tests compare the stages with brute force

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"), learnable=fold_of() != 1)
    return quality.keep_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = "id_and_text"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = jaccard.jaccard_components(keyed.select(key, "text"), id_col=key).select(F.col("doc_id").alias(key), "component_id").distinct()
    pairs = keyed.select("doc_id", key).distinct().join(found, key)
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", key)
    kept = pairs.groupBy("component_id").agg(F.min(order).alias("least")).select(f"least.{key}")
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*[column(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, copy_name="_copy", order_name="_order").select(*[column(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
