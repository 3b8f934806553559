"""Stock movements applied in time order, with sales refused when stock is short.

A refused sale must not affect what follows, so the level is no running sum: each
movement depends on the outcome of the one before. Movements are range-partitioned
by (product, store, time), so a key with a large share of all movements spans several
neighbouring ranges, and every range is walked as a stream with one level of state.

A range that begins in the middle of a key needs the level the range before closes
with. It is first walked from the key's opening level; the ranges of such keys are
then chained. A range whose running sum never falls below what it opens with refuses
nothing, so it closes at opening + net without another walk; the others are walked
again, all at once, until each has been walked from the level it really opens with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.columns import align_keys
from larder.schemas import KEYS
from larder.session import stage

SALE, RESTOCK = "SALE", "RESTOCK"
LOG_COLUMNS = ["event_id", "ts", *KEYS, "qty", "tx_type", "accepted", "reason", "stock_after"]
_LOCAL_BITS = 33


def take_in_order(opening: int, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level after each movement, whether it was taken) of one stretch that opens at ``opening``.

    Up to the first sale that might be refused, and in stretches without one, levels are running sums.
    """
    levels = opening + np.cumsum(delta)
    taken = np.ones(len(delta), dtype=bool)
    short = np.flatnonzero(levels < 0)
    if len(short):
        at = int(short[0])
        now = int(levels[at - 1]) if at else opening
        for i, d in enumerate(delta[at:].tolist(), at):
            if d >= 0 or now + d >= 0:
                now += d
            else:
                taken[i] = False
            levels[i] = now
    return levels, taken


def _walk(openings: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over rows sorted by range and position.

    Adds the level after each movement, whether it was accepted, and the running sum
    the group would have without refusals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level, total = None, 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part, group = batch.column("_range"), batch.column("_group")
            delta = batch.column("_delta").to_numpy(zero_copy_only=False)
            changes = pc.or_(pc.not_equal(part[1:], part[:-1]), pc.not_equal(group[1:], group[:-1]))
            starts = np.r_[0, np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1]
            sizes = np.diff(np.r_[starts, batch.num_rows])
            parts = part.to_numpy(zero_copy_only=False)[starts]
            opening = batch.column("_opening").to_numpy(zero_copy_only=False)[starts].copy()
            if openings:
                opening = np.array([openings.get(int(p), o) for p, o in zip(parts, opening)])
            before = np.zeros_like(opening)
            if last == (part[0].as_py(), group[0].as_py()):
                opening[0], before[0] = level, total
            sums = np.cumsum(delta)
            sums -= np.repeat(sums[starts] - delta[starts], sizes)
            levels = np.repeat(opening, sizes) + sums
            taken = np.ones(batch.num_rows, dtype=bool)
            for i in np.flatnonzero(np.minimum.reduceat(levels, starts) < 0):
                part_of = slice(starts[i], starts[i] + sizes[i])
                levels[part_of], taken[part_of] = take_in_order(int(opening[i]), delta[part_of])
            totals = sums + np.repeat(before, sizes)
            last, level, total = (part[-1].as_py(), group[-1].as_py()), levels[-1], totals[-1]
            keep = [n for n in batch.schema.names if n not in ("stock_after", "accepted", "_total")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(levels), pa.array(taken), pa.array(totals)],
                names=[*keep, "stock_after", "accepted", "_total"],
            )

    return run


def _walked(rows: DataFrame, openings: dict[int, int]) -> DataFrame:
    base = rows.drop("stock_after", "accepted", "_total")
    schema = T.StructType([*base.schema.fields])
    schema.add("stock_after", "long").add("accepted", "boolean").add("_total", "long")
    return base.mapInArrow(_walk(openings), schema)


def opening_levels(stock: DataFrame, name: str) -> DataFrame:
    """One level per product and store; a repeated key is an error."""
    level = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate product and store in stock"))).otherwise(F.min("stock_levels"))
    return stock.groupBy(*KEYS).agg(level.cast("long").alias(name))


def _judged(movements: DataFrame, stock: DataFrame) -> DataFrame:
    """Movements with the opening level of their key, the signed quantity, and the reason why they cannot count, if any.

    A movement that cannot count moves its key by nothing.
    """
    levels = opening_levels(stock, "_first")
    movements, levels = align_keys(movements, levels)
    reason = (
        F.when(F.coalesce(F.trim(F.col("store_id").cast("string")), F.lit("")) == "", "invalid store id")
        .when(F.col("qty").isNull(), "invalid quantity")
        .when(~F.coalesce(F.col("tx_type").isin(SALE, RESTOCK), F.lit(False)), "unknown type")
        .when(F.col("_first").isNull(), "unknown product and store")
    )
    signed = F.when(F.col("tx_type") == SALE, -F.col("qty")).otherwise(F.col("qty")).cast("long")
    joined = movements.join(levels, KEYS, "left").select("event_id", "ts", *KEYS, "qty", "tx_type", "_first", reason.alias("_reason"))
    return joined.select(
        "*",
        F.coalesce("_first", F.lit(0)).cast("long").alias("_opening"),
        F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in KEYS]).alias("_group"),
        F.when(F.col("_reason").isNull(), signed).otherwise(0).cast("long").alias("_delta"),
    )


def settle(movements: DataFrame, stock: DataFrame, ranges: int | None = None) -> DataFrame:
    """Log of every movement with ``accepted``, ``reason`` and the level after it.

    Movements of a key are taken in the order of (ts, event_id). A sale larger than
    the level is refused; so are unknown keys, blank stores and unknown types, which show the opening level of their key. ``ranges`` sets
    the number of ranges; by default the shuffle width and AQE do. Movements meet the stock once: the joined rows
    are staged before the range exchange samples them.
    """
    judged = stage(_judged(movements, stock), "ledger-judged")
    order = [*KEYS, "ts", "event_id"]
    ranged = (
        (judged.repartitionByRange(ranges, *order) if ranges else judged.repartitionByRange(*order))
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_slot", _LOCAL_BITS).cast("int"))
    )
    walked = stage(_walked(ranged, {}), "ledger")
    settled = _chained(walked)
    counts = F.col("_reason").isNull()
    return settled.withColumns(
        {
            "reason": F.coalesce("_reason", F.when(~F.col("accepted"), "not enough stock")),
            "accepted": counts & F.col("accepted"),
            "stock_after": F.when(counts, F.col("stock_after")).otherwise(F.col("_first")),
        }
    ).select(*LOG_COLUMNS)


def _chained(walked: DataFrame) -> DataFrame:
    """Correct the ranges that begin in the middle of a key. The driver holds one row per range."""
    edges = sorted(
        walked.groupBy("_range")
        .agg(
            F.min_by("_group", "_slot").alias("first"),
            F.max_by("_group", "_slot").alias("last"),
            F.max_by("stock_after", "_slot").alias("level"),
        )
        .collect()
    )
    continued = {b["_range"]: b["first"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}
    if not continued:
        return walked
    spark = walked.sparkSession
    heads = F.broadcast(spark.createDataFrame(list(continued.items()), "_range int, _group string"))
    head_rows = walked.join(heads, ["_range", "_group"], "left_semi")
    facts = {
        r["_range"]: (max(0, -r["low"]), r["net"], r["level"])
        for r in head_rows.groupBy("_range")
        .agg(F.min("_total").alias("low"), F.max_by("_total", "_slot").alias("net"), F.max_by("stock_after", "_slot").alias("level"))
        .collect()
    }

    def again(parts: dict[int, int]) -> DataFrame:
        rows = head_rows.where(F.col("_range").isin(list(parts)))
        whole = rows.repartition("_range").sortWithinPartitions("_range", "_slot")
        return _walked(whole, parts)

    known: dict[tuple[int, int], int] = {}
    guess = {part: level for part, (_, _, level) in facts.items()}
    while True:
        opens, todo, closing = {}, {}, None
        for edge in edges:
            part = edge["_range"]
            if part not in continued:
                closing = edge["level"]
                continue
            need, net, _ = facts[part]
            opens[part] = closing
            if closing >= need:
                head = closing + net
            elif (part, closing) in known:
                head = known[part, closing]
            else:
                todo[part] = closing
                head = guess[part]
            closing = head if edge["first"] == edge["last"] else edge["level"]
        if not todo:
            break
        ends = again(todo).groupBy("_range").agg(F.max_by("stock_after", "_slot").alias("level"))
        for row in ends.collect():
            known[row["_range"], todo[row["_range"]]] = row["level"]
            guess[row["_range"]] = row["level"]
    rest = walked.join(heads, ["_range", "_group"], "left_anti")
    return rest.unionByName(again(opens).select(*rest.columns))


def closing_stock(stock: DataFrame, log: DataFrame) -> DataFrame:
    """Stock table after the accepted movements of a log."""
    from larder.operators.matching import add_quantities

    change = F.when(F.col("tx_type") == SALE, -F.col("qty")).otherwise(F.col("qty"))
    return add_quantities(stock, log.where("accepted").withColumn("_delta", change), qty="_delta")


def adjust(stock: DataFrame, changes: DataFrame, qty: str = "amount") -> tuple[DataFrame, DataFrame]:
    """(stock after signed adjustments without a stock check, adjustments of unknown keys)."""
    from larder.operators.matching import add_quantities, unmatched_only

    return add_quantities(stock, changes, qty=qty), unmatched_only(changes, stock)
