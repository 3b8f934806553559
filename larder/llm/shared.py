"""Small helpers used by several operators: staged tables, key bitmaps, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import shared_dir, stage

__all__ = ["KeyBitmap", "bytes_of", "column", "filtered_in_arrow", "key_bitmap", "numbered", "shared_dir", "slot_of", "stage", "table", "union_all"]

WORD_SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def filtered_in_arrow(docs: DataFrame, keep, text_col: str) -> DataFrame:
    """``docs`` through a batch filter ``keep(batches, text_col)``; columns may have any names, dots included."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = plain.mapInArrow(partial(keep, text_col=f"c{docs.columns.index(text_col)}"), plain.schema)
    return kept.toDF(*docs.columns)


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Values of a binary column; null reads as empty."""
    return [v if v is not None else b"" for v in batch.column(name).to_pylist()]


EQUAL_ROWS = 100_000  # rows of one key that are numbered in one task
BROADCAST_KEYS = 1_000_000  # of 16 bytes


def numbered(rows: DataFrame, key: str, name: str, label: str) -> DataFrame:
    """``rows`` with ``name``: 0 for a row whose ``key`` is its own, and 0, 1, 2 ... among rows of one key.

    Keys that occur once are only counted, their rows stay where they are. Rows of the others are numbered by a
    window over key and part: a key of more than ``EQUAL_ROWS`` rows is dealt over several parts, whose numbers
    interleave. The numbered rows are staged, so that every reader sees the same numbers.
    """
    counted = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_times")).filter("_times > 1")
    again = stage(counted, f"{label}-keys")
    n = again.count()
    if not n:
        return rows.withColumn(name, F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(again) if n <= BROADCAST_KEYS else again, F.col(key) == F.col("_key"), "left")
    parts = F.ceil(F.col("_times") / EQUAL_ROWS)
    dealt = marked.filter("_times is not null").withColumn("_parts", parts).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")))
    rank = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_part")) - 1
    same = dealt.select(*rows.columns, (rank * F.col("_parts") + F.col("_part")).cast("long").alias(name))
    alone = marked.filter("_times is null").select(*rows.columns, F.lit(0).cast("long").alias(name))
    return alone.unionByName(stage(same, label))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class KeyBitmap:
    """Fixed-size bitmap over hashed keys: no false negatives, so an exact join may follow.

    Its size depends on ``bits`` alone (2 MiB at 24), which bounds what is broadcast.
    A full bitmap lets every key pass; that costs work and never changes a result.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def hit(self, slots: np.ndarray) -> np.ndarray:
        s = slots.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        return ((self.words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1)).astype(bool)


def slot_of(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << bits) - 1))


def key_bitmap(hashes: DataFrame, bits: int = 24) -> KeyBitmap:
    """Bitmap of the low ``bits`` bits of the only column (a hash).

    At most 2**(bits - 6) sums of 64 slots each reach the driver.
    """
    name = hashes.columns[0]
    slots = hashes.select(slot_of(column(name), bits).alias("slot"))
    words = (
        slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return KeyBitmap(out, bits)


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
