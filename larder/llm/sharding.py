"""Sharding by histogram sort: probe byte counts until every splitter is found, then exchange once.

Rows are ordered by a 60-bit hash of id, text and a number that tells rows equal in both apart, so a source, a group of copies,
a row that stands a thousand times or a run of ids spreads over all shards. Shard s begins at the smallest key below which s / shards of all bytes lie.

Each round counts the exact bytes and rows below a few thousand candidate keys across all
partitions (a grouped sum with map-side combine over a narrow table of keys and sizes), keeps the
one interval of each splitter that still holds it, and probes that interval finer. A splitter is
settled when its interval holds at most ``tolerance`` bytes or one key. A round brings at most
2**STEP counts per splitter to the driver. With the splitters known, rows move once, into pieces
of a shard; a row's slot is its rank in its piece plus the rows counted in the pieces before.

Rows: null text counts as empty, null id as an empty id; rows equal in id and text are numbered and take the places
of their numbers, in any order; texts of any length are measured whole; an empty table gives an empty result; other
columns are carried, and columns named as the two added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.shared import column, numbered, stage

KEY_BITS, STEP = 60, 12
PIECE_BYTES = 64 << 20
ROW_BYTES = 16
LAW = "bytes"


def row_key(id_col: str, text_col: str) -> Column:
    """60-bit key of id and text; the separator keeps them apart."""
    return _key(_identity(id_col, text_col))


def _identity(id_col: str, text_col: str) -> Column:
    parts = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.md5(F.concat(parts[0], F.lit(":"), parts[1]))


def _key(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _keyed(docs: DataFrame, own: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, key, size): the first row of an id and text has their key, each further one a key of its own."""
    carried = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(own)]) if own else F.struct(F.lit(0).alias("c"))
    rows = docs.select(carried.alias("row"), _identity(id_col, text_col).alias("digest"), row_size(text_col).alias("size"))
    numbered_rows = numbered(rows, "digest", "number", "sharding-equal")
    further = F.md5(F.concat(F.col("digest"), F.lit(":"), F.col("number").cast("string")))
    return numbered_rows.select("row", _key(F.when(F.col("number") == 0, F.col("digest")).otherwise(further)).alias("key"), "size")


def row_size(text_col: str) -> Column:
    """UTF-8 bytes of the text and a fixed share per row."""
    return F.coalesce(F.octet_length(column(text_col)), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


@dataclass
class _Splitter:
    """Target bytes, and the interval [low, low + 2**bits) that holds the boundary; ``below`` bytes lie under it."""

    target: float
    low: int = 0
    bits: int = KEY_BITS
    below: int = 0
    at: int | None = None


def find_splitters(keyed: DataFrame, shards: int, tolerance: int = 0) -> tuple[list[int], int]:
    """First key of each shard but the first, and the bytes in all, from a table (key, size)."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    # kept times ``shards``, so that targets are whole numbers
    splitters = [_Splitter(target=s * total) for s in range(1, shards)] if total else []
    bits = KEY_BITS
    while open_ := [x for x in splitters if x.at is None]:
        fine = bits - STEP
        inside = keyed
        if bits < KEY_BITS:
            inside = keyed.filter(F.shiftright("key", bits).isin(sorted({x.low >> bits for x in open_})))
        counts: dict[int, list] = {}
        probes = inside.groupBy(F.shiftright("key", fine).alias("cell")).agg(
            F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last")
        )
        for row in probes.collect():  # at most 2**STEP for each open interval
            counts.setdefault(row["cell"] >> STEP, []).append(tuple(row))
        for cells in counts.values():
            cells.sort()
        for x in open_:
            below = x.below
            for cell, size, first, last in counts[x.low >> bits]:
                if (below + size) * shards >= x.target:
                    x.low, x.bits, x.below = cell << fine, fine, below
                    if first == last or fine == 0:
                        x.at = last + 1
                    elif size <= tolerance:
                        x.at = (cell + 1) << fine
                    break
                below += size
        bits = fine
    return [x.at for x in splitters], total


def shard_by_bytes(
    docs: DataFrame,
    shards: int,
    tolerance: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_name: str = "shard",
    slot_name: str = "slot",
) -> DataFrame:
    """``docs`` with a shard of nearly equal bytes and a gapless slot in it, rows moved to their place.

    ``shard_name`` and ``slot_name`` replace columns of these names.
    """
    own = [c for c in docs.columns if c not in (shard_name, slot_name)]
    rows = _keyed(docs, own, id_col, text_col)
    keyed = stage(rows.select("key", "size"), "sharding-keys")
    splitters, total = find_splitters(keyed, shards, tolerance)
    piece_bits = min(KEY_BITS, max(STEP, min(20, (total // PIECE_BYTES).bit_length())))

    def placed(key: Column) -> list[Column]:
        bounds = F.array(*[F.lit(s).cast("long") for s in splitters]) if splitters else F.expr("cast(array() as array<bigint>)")
        return [F.size(F.filter(bounds, lambda s: s <= key)).alias("shard"), F.shiftright(key, KEY_BITS - piece_bits).alias("piece")]

    pieces = keyed.select(*placed(F.col("key"))).groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # one row per piece: 2**20 + shards at most
    offsets = pieces.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))

    moved = rows.select("row", "key", *placed(F.col("key")))
    rank = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key"))
    ranked = moved.withColumn("rank", rank).join(offsets, ["shard", "piece"])
    return ranked.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(own)],
        F.col("shard").cast("int").alias(shard_name),
        (F.col("offset") + F.col("rank") - 1).cast("long").alias(slot_name),
    )
