"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, k drawn from a Poisson distribution whose mean is the repetition
rate of its source: target weight x rows wanted / rows of the source. The draw inverts the distribution
at a uniform number hashed from seed and document, so a rerun gives the same corpus. Means above
``CHUNK_MEAN`` are drawn as sums of independent parts, since exp(-mean) would vanish. Copies are then
shuffled globally: ordered by a hash of document and copy over range partitions. Rows meet the rates of
their source in place, by a broadcast, unless there are very many sources.

Without weights, sources are tempered: weight ~ rows ** ``temper``. Sources without a given weight get none.

A row is known by its id, its text and, among rows equal in both, a number. So rows without an id, texts that share one
and repeated rows draw for themselves, and their copies are spread like all others.

Rows: a null source is a source of its own; null ids and texts count as empty; texts of any length are hashed whole;
an empty table or no positive weight gives an empty result; other columns are carried, and columns named as the
two added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import column, numbered, stage

CHUNK_MEAN = 32.0
TERMS = 128  # terms of a chunk's distribution; the rest has a mass under 1e-30
BROADCAST_SOURCES = 10_000  # a row has about a kilobyte; more sources are joined by a shuffle
UNIT_DIGITS = 13  # 52 bits, exact in a double


def uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from an MD5 of the parts."""
    joined = F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if i == 0 else F.concat(F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for i, p in enumerate(parts)])
    return F.conv(F.substring(F.md5(joined), 1, UNIT_DIGITS), 16, 10).cast("long") / F.lit(float(16**UNIT_DIGITS))


def poisson_steps(mean: Column) -> Column:
    """Cumulative distribution of a Poisson variable of ``mean`` up to ``TERMS`` terms, as an array."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("steps")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"), (a["c"] + a["p"] * mean / k).alias("c"), F.array_append(a["steps"], a["c"] + a["p"] * mean / k).alias("steps")
        ),
        lambda a: a["steps"],
    )


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, total: int | None, temper: float, source_col: str) -> DataFrame:
    """(source, parts, steps) per source: number of independent draws and the distribution of each."""
    counted = docs.groupBy(column(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighted = counted.withColumn("weight", F.pow(F.col("rows"), F.lit(temper)))
    else:
        given = F.lit(None).cast("double")
        for name, w in weights.items():
            given = F.when(F.col("source") == name, F.lit(float(w))).otherwise(given)
        weighted = counted.withColumn("weight", F.coalesce(given, F.lit(0.0)))
    sums = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    wanted = F.col("all_rows") if total is None else F.lit(total)
    mean = F.col("weight") / F.col("all_weight") * wanted / F.col("rows")
    rated = weighted.join(F.broadcast(sums), F.lit(True)).filter("all_weight > 0").select("source", mean.alias("mean"))  # one row of sums
    parted = rated.select("source", "mean", F.greatest(F.ceil(F.col("mean") / CHUNK_MEAN), F.lit(1)).cast("int").alias("parts"))
    return parted.select("source", "parts", (F.col("mean") / F.col("parts")).alias("part_mean")).select("source", "parts", poisson_steps(F.col("part_mean")).alias("steps"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: int | None = None,
    temper: float = 0.5,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copy_name: str = "copy",
    order_name: str = "shuffle_key",
) -> DataFrame:
    """``docs`` repeated at their source's rate, with copy number and shuffle key, in shuffled order.

    ``total``: rows wanted in expectation (as many as there are, by default). A table without ``text_col`` is told apart by ids and numbers.
    """
    own = [c for c in docs.columns if c not in (copy_name, order_name)]
    rates = stage(repetition_rates(docs, weights, total, temper, source_col), "mixing-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    known = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (id_col, text_col) if c in docs.columns]
    rows = docs.select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(own)]).alias("row"), column(source_col).alias("_source"), F.md5(F.concat_ws(":", *known)).alias("_id")
    )
    rated = numbered(rows, "_id", "_number", "mixing-equal").join(rates, F.col("_source").eqNullSafe(F.col("source")))

    def draw(part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("_id"), F.col("_number"), part)
        return F.aggregate(F.array(u), F.lit(0), lambda _, x: F.size(F.filter("steps", lambda s: s <= x)))

    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + draw(part))
    drawn = rated.select("row", "_id", "_number", count.alias("n")).filter("n > 0")
    copies = drawn.select("row", "_id", "_number", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.select("row", "copy", F.md5(F.concat_ws(":", F.lit(f"order {seed}"), "_id", "_number", "copy")).alias("key"))
    return keyed.repartitionByRange("key").sortWithinPartitions("key").select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(own)], F.col("copy").cast("long").alias(copy_name), F.col("key").alias(order_name)
    )
