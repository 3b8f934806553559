"""Connected components as Spark joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round re-hangs all neighbours of a node under its smallest neighbour, once upwards and
    once downwards, and ends when no edge moves. Rounds are cut by tables in the shared folder;
    nothing but a count and a checksum reaches the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs, mark = _cut(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, both.filter("v > u"))
        small = _hang(large, large, own=True)
        pairs, new = _cut(small)
        if new == mark:
            break
        mark = new
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _hang(pairs: DataFrame, moved: DataFrame, own: bool = False) -> DataFrame:
    """Edges from each moved neighbour (and the node itself) to the node's smallest neighbour."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _cut(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    kept = stage(pairs, "components")
    row = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return kept, (row["n"], row["s"])
