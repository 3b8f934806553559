"""Stock movements as a stream: settle, log, keep stock current, check for reorders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from larder.operators.columns import align_keys
from larder.operators.ledger import RESTOCK, SALE, opening_levels, settle, take_in_order
from larder.operators.matching import add_quantities
from larder.plans.monitor import kpis
from larder.plans.reorder import reorder_suggestions
from larder.schemas import KEYS, MOVEMENTS
from larder.sources.files import remove, subfolders
from larder.sources.tables import VersionedTable

Trigger = dict[str, object]
REFRESH: Trigger = {"processingTime": "5 minutes"}
ONCE: Trigger = {"availableNow": True}


def movement_source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet movement files as a stream; the file cap bounds one micro-batch."""
    return spark.readStream.schema(MOVEMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def touched(batch: DataFrame) -> DataFrame:
    return batch.select(*KEYS).distinct()


def touched_reorders(batch: DataFrame, stock: DataFrame, forecast: DataFrame) -> DataFrame:
    """Reorder suggestions for the keys a batch has moved."""
    keys, rows = align_keys(touched(batch), stock)
    return reorder_suggestions(forecast, rows.join(keys, KEYS, "left_semi"), fallback=False)


MERGE_EVERY = 20


def stock_after(stock: VersionedTable, batches: int, merge_every: int = MERGE_EVERY, keys: DataFrame | None = None) -> DataFrame:
    """Stock table after the first ``batches`` micro-batches (of ``keys`` only, if given).

    It is the last merged version and the changes of the batches since: at most ``merge_every`` small folders.
    """
    version = batches // merge_every
    base = stock.read(version)
    if keys is not None:
        own, rows = align_keys(keys, base)
        base = rows.join(own, KEYS, "left_semi")
    changes = _changes(stock, range(version * merge_every, batches))
    return base if changes is None else add_quantities(base, changes, qty="change")


def newest_before(stock: VersionedTable, batches: int, merge_every: int = MERGE_EVERY) -> DataFrame | None:
    """(product_id, store_id, newest): time of the last movement of each key in the first ``batches`` micro-batches."""
    version = batches // merge_every
    parts = [] if version == 0 else [stock.spark.read.parquet(f"{stock.path}/newest/v={version}").select(*KEYS, "newest")]
    changes = _changes(stock, range(version * merge_every, batches))
    if changes is not None:
        parts.append(changes.select(*KEYS, "newest"))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.max("newest").alias("newest"))


def _changes(stock: VersionedTable, batches: range) -> DataFrame | None:
    paths = [f"{stock.path}/changes/batch={b}" for b in batches]
    return stock.spark.read.parquet(*paths) if paths else None


def kpis_after(stock: VersionedTable, batches: int) -> DataFrame:
    """Dashboard KPIs after the first ``batches`` micro-batches of a stream that keeps them: one row is read."""
    return stock.spark.read.parquet(f"{stock.path}/kpis/batch={batches - 1}")


def _refresh_kpis(stock: VersionedTable, batch_id: int, merge_every: int, keys: DataFrame, as_of: str) -> None:
    """KPIs of a batch from those of the one before and the rows it has moved; the first reads the whole table."""
    first = kpis(stock.read(0), as_of=as_of) if batch_id == 0 else kpis_after(stock, batch_id)
    rows = [(first, 1), *((kpis(stock_after(stock, n, merge_every, keys), as_of=as_of), sign) for n, sign in ((batch_id, -1), (batch_id + 1, 1)))]
    signed = [df.select(*[(F.col(c) * sign).alias(c) for c in first.columns]) for df, sign in rows]
    total = reduce(DataFrame.unionByName, signed).agg(*[F.sum(c).cast("long").alias(c) for c in first.columns])
    total.write.mode("overwrite").parquet(f"{stock.path}/kpis/batch={batch_id}")


def _retire(stock: VersionedTable, oldest: int, merge_every: int) -> None:
    """Remove versions below ``oldest``, their newest times and the changes they have taken in."""
    stock.retire(oldest)
    for folder, kept in (("newest/v=", oldest), ("changes/batch=", oldest * merge_every)):
        parent, head = folder.split("/")
        for name in subfolders(stock.spark, f"{stock.path}/{parent}"):
            if name.startswith(head) and int(name[len(head) :]) < kept:
                remove(stock.spark, f"{stock.path}/{parent}/{name}")


def settle_batches(
    movements: DataFrame,
    stock: VersionedTable,
    log_path: str,
    checkpoint: str,
    forecast: DataFrame | None = None,
    suggestions_path: str | None = None,
    trigger: Trigger = ONCE,
    on_batch: Callable[[int], None] | None = None,
    merge_every: int = MERGE_EVERY,
    keep: int | None = None,
    kpis_as_of: str | None = None,
) -> StreamingQuery:
    """Settle every micro-batch against the stock and start the query.

    A batch reads and writes the keys it moves only: its log, and the net change and last time of each
    key. After every ``merge_every`` batches the changes are merged into the next version of the stock
    table; ``stock_after`` gives the stock at any batch. With a forecast, suggestions for the
    moved keys are written too. A batch that is run again after a failure overwrites its own folders from the
    same state, so each movement counts once. The stock must have been written as version 0. A hot key
    is split the way ``settle`` splits it. A movement older than one of an earlier batch is applied
    and marked ``late``; ``keyed_ledger`` holds movements back until their order is certain.

    Merges are published like any version of the table, under the name of the stream's checkpoint: a merge that is run again
    leaves its version as it is, and a version that someone else has published meanwhile stops the stream
    with ``ForeignVersion`` and is not touched. ``keep``: so many merged versions stay for readers, two at least, as a
    batch may be run again; older ones go, with the changes that led to them.

    ``kpis_as_of``: dashboard KPIs are kept for every batch, as those of the batch before, less those of the moved rows as they were,
    plus those of the rows as they are; ``kpis_after`` reads them.
    """
    owner = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = stock_after(stock, batch_id, merge_every, touched(batch))
        settled = settle(batch, before)
        newest = newest_before(stock, batch_id, merge_every)
        if newest is None:
            marked = settled.withColumn("late", F.lit(False))
        else:
            settled, newest = align_keys(settled, newest)
            marked = settled.join(newest, KEYS, "left").withColumn("late", F.coalesce(F.col("ts") < F.col("newest"), F.lit(False))).drop("newest")
        out = f"{log_path}/batch={batch_id}"
        marked.write.mode("overwrite").parquet(out)
        log = spark.read.parquet(out)
        signed = F.when(F.col("tx_type") == SALE, -F.col("qty")).otherwise(F.col("qty"))
        net = log.groupBy(*KEYS).agg(F.coalesce(F.sum(F.when(F.col("accepted"), signed)), F.lit(0)).alias("change"), F.max("ts").alias("newest"))
        net.write.mode("overwrite").parquet(f"{stock.path}/changes/batch={batch_id}")
        done = batch_id + 1
        if done % merge_every == 0:
            version = done // merge_every
            merged = add_quantities(stock.read(version - 1), _changes(stock, range(done - merge_every, done)), qty="change")
            stock.write(merged, version, owner)
            times = [_changes(stock, range(done - merge_every, done)).select(*KEYS, "newest")]
            if version > 1:
                times.append(spark.read.parquet(f"{stock.path}/newest/v={version - 1}").select(*KEYS, "newest"))
            latest = reduce(DataFrame.unionByName, times).groupBy(*KEYS).agg(F.max("newest").alias("newest"))
            latest.write.mode("overwrite").parquet(f"{stock.path}/newest/v={version}")
        if kpis_as_of is not None:
            _refresh_kpis(stock, batch_id, merge_every, touched(log), kpis_as_of)
        if keep is not None and done % merge_every == 0:
            _retire(stock, done // merge_every - max(keep, 2) + 1, merge_every)
        if forecast is not None and suggestions_path:
            after = stock_after(stock, done, merge_every, touched(log))
            touched_reorders(log, after, forecast).write.mode("overwrite").parquet(f"{suggestions_path}/batch={batch_id}")
        if on_batch:
            on_batch(batch_id)

    return (
        movements.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


LEVELS = "event_id long, ts timestamp, product_id string, store_id string, qty long, tx_type string, accepted boolean, reason string, stock_after long, late boolean"
HEARTBEAT = "HEARTBEAT"
WAITING = "event_id long, micros long, qty long, tx_type string, late boolean"


class _Ledger(StatefulProcessor):
    """One key's ledger: its stock level, and the movements that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level long")
        self.alarm = handle.getValueState("alarm", "at long")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        level = self.level.get() if self.level.exists() else None
        first = None
        for part in rows:
            part = part[part["tx_type"].ne(HEARTBEAT)]
            if part.empty:
                continue
            micros = part["ts"].to_numpy("datetime64[us]").astype(np.int64)
            if level is None and part["opening"].notna().any():
                level = (int(part["opening"].dropna().iloc[0]),)
                self.level.update(level)
            qty = [None if pd.isna(q) else int(q) for q in part["qty"]]
            kind = [None if pd.isna(k) else k for k in part["tx_type"]]
            ids = [None if pd.isna(i) else int(i) for i in part["event_id"]]
            self.waiting.appendList(list(zip(ids, micros.tolist(), qty, kind, (micros < passed).tolist(), strict=True)))
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if first is not None:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.alarm.exists() or self.alarm.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return iter([])
        self.alarm.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        due = sorted((r for r in rows if r[1] < passed), key=lambda r: (r[1], r[0] is not None, r[0] or 0))
        rest = [tuple(r) for r in rows if r[1] >= passed]
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[1] for r in rest))
        else:
            self.waiting.clear()
        return iter([self._applied(key, due)] if due else [])

    def _wake(self, micros: int) -> None:
        """One timer a key, at the first millisecond that lies after its earliest waiting movement."""
        at = micros // 1000 + 1
        if self.alarm.exists():
            if self.alarm.get()[0] <= at:
                return
            self.handle.deleteTimer(self.alarm.get()[0])
        self.alarm.update((at,))
        self.handle.registerTimer(at)

    def _applied(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        level = self.level.get()[0] if self.level.exists() else None
        ids, micros, qty, kinds, late = zip(*rows, strict=True)
        reasons = [self._refusal(key, q, k, level) for q, k in zip(qty, kinds, strict=True)]
        delta = np.array([0 if r else q * (-1 if k == SALE else 1) for q, k, r in zip(qty, kinds, reasons, strict=True)], np.int64)
        levels, taken = take_in_order(level or 0, delta)
        if level is not None:
            self.level.update((int(levels[-1]),))
        reasons = [r or (None if t else "not enough stock") for r, t in zip(reasons, taken, strict=True)]
        return pd.DataFrame(
            {
                "event_id": pd.array(ids, dtype="Int64"),
                "ts": pd.to_datetime(np.array(micros, np.int64), unit="us"),
                "product_id": key[0],
                "store_id": key[1],
                "qty": pd.array(qty, dtype="Int64"),
                "tx_type": pd.Series(kinds, dtype=object),
                "accepted": [r is None for r in reasons],
                "reason": pd.Series(reasons, dtype=object),
                "stock_after": pd.array(levels if level is not None else [None] * len(levels), dtype="Int64"),
                "late": list(late),
            }
        )

    @staticmethod
    def _refusal(key: tuple, qty: int | None, kind: str | None, level: int | None) -> str | None:
        if not str(key[1] or "").strip():
            return "invalid store id"
        if qty is None:
            return "invalid quantity"
        if kind not in (SALE, RESTOCK):
            return "unknown type"
        return "unknown product and store" if level is None else None


def keyed_ledger(movements: DataFrame, stock: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming log in event-time order, with the stock level kept as state per product and store.

    A movement waits in its key's state until the watermark, the latest time seen less ``delay``, has passed it. A timer
    then releases all that are due, in the order of (ts, event_id), however they came in and in however many
    batches. One that arrives behind the watermark is taken with the next release and marked ``late``. Rows of type
    ``HEARTBEAT`` move the watermark on and are not logged, so that the last movements of a quiet stream come out. A release holds the due
    movements of one key in memory: at most those of ``delay`` and one micro-batch. Movements without a time are dropped.
    """
    levels = opening_levels(stock, "opening")
    # the watermark sits on a column of its own: a late row must not be filtered out before it is marked
    timed = movements.where("ts is not null").withColumn("_seen", F.col("ts")).withWatermark("_seen", delay).drop("_seen")
    timed, levels = align_keys(timed, levels)
    rows = timed.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in KEYS}).join(
        levels.withColumns({k: F.col(k).cast("string") for k in KEYS}), KEYS, "left"
    )
    return rows.groupBy(*KEYS).transformWithStateInPandas(_Ledger(), LEVELS, "append", "EventTime")


def append_log(log: DataFrame, path: str, checkpoint: str, trigger: Trigger = ONCE) -> StreamingQuery:
    """Append a streaming log to a parquet folder."""
    return (
        log.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
