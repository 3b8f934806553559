"""Substring dedup: heads of ``window`` words of all suffixes, compared in hash groups.

A suffix starts at every word; what matters of it is its first ``window`` words, so a tree of
depth ``window`` is enough: two suffixes share a node at that depth exactly where a repeat of
``window`` words or more begins. Every occurrence but the first (smallest doc_id, then smallest
start) is removed, and runs of such nodes along a text are its maximal repeats.

No tree is built: its nodes at that depth are the equal heads. Suffixes are split into groups that are compared one at a time:

* The group of a suffix is its *anchor*, the smallest hash of the ``anchor``-word grams in its first
  ``window`` words. Equal suffix heads have equal anchors, and neighbours in a text mostly share
  one, so a run of neighbours travels as one row. (The anchor takes the place of the leading
  words: groups by leading words would send every suffix on its own.)
* Anchors are counted first. One that occurs once has no deep internal node and is not sent.
* The prefix is of variable length: where a group would outgrow memory, its suffixes are split by
  all ``window`` words, and each task sends the first occurrence only.

Counting covers all documents. What is broadcast has a fixed size: a bitmap of repeated anchors
(a full one costs shuffle, not results) and at most ``HOT_KEYS`` anchors of large groups.

Rows: null or empty text has no words; a row without doc_id sorts before all others; rows that share
a doc_id are one document, whose equal starts are no earlier occurrence of each other (their texts are told
apart by 64-bit hashes); texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import KeyBitmap, bytes_of, column, key_bitmap, stage
from larder.llm.wordhash import grams, sliding_min, word_hashes

WINDOW, ANCHOR = 20, 8
FILTER_BITS = 26
HOT_KEYS, HOT_ROWS = 1 << 16, 4096
NO_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept): one row per row of ``docs``.

    ``repeats`` lists the removed word ranges (start, length); ``kept`` joins the other words by blanks.
    """
    texts = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(id_col).cast("long"), F.lit(NO_ID)).alias("pos_id"),
        F.xxhash64(column(text_col)).alias("text_key"),
        column(text_col).cast("binary").alias("text"),
    )
    size = dict(window=window, anchor=anchor)
    runs = texts.select("text").mapInArrow(partial(_anchors, **size), "key long, n int")
    counted = stage(runs.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "repeats-anchors")
    repeated = key_bitmap(counted.select("key"), FILTER_BITS)
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = counted.filter(F.col("n") > limit).select("key").toArrow().column(0).to_numpy()  # at most HOT_KEYS rows
    shared = texts.sparkSession.sparkContext.broadcast((repeated, np.sort(hot)))

    suffixes = texts.select("pos_id", "text_key", "text").mapInArrow(
        partial(_suffixes, shared=shared, **size), "key long, pos_id long, text_key long, start int, n int, heads array<long>"
    )
    spans = (
        suffixes.repartition("key")
        .sortWithinPartitions("key", "pos_id", "start")
        .mapInArrow(_deep_nodes, "pos_id long, text_key long, span long")
        .groupBy("pos_id", "text_key")
        .agg(F.collect_list("span").alias("spans"))
    )
    cut = texts.join(spans, ["pos_id", "text_key"], "left").select("doc_id", "text", "spans")
    return cut.mapInArrow(
        partial(_cut, window=window), "doc_id long, n_words long, n_removed long, repeats array<struct<start: int, length: int>>, kept binary"
    ).withColumn("kept", F.col("kept").cast("string"))


def _runs(text: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of grams; anchor, first window and number of windows of each run of windows with one anchor."""
    words = word_hashes(text)
    if len(words) < window:
        empty = np.empty(0, np.int64)
        return words, words[:0], words[:0], empty, empty
    hashes = grams(words, anchor)
    least = sliding_min(hashes, window - anchor + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return words, hashes, least[starts], starts, np.diff(np.append(starts, len(least)))


def _times(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, reach: int) -> np.ndarray:
    """How often a run's anchor counts: twice if the run may hold equal windows, as texts with a short period do.

    Equal windows of one run are at most ``reach`` apart, or the run is longer than one occurrence allows; in
    the first case some gram of the run comes again that near.
    """
    again = np.zeros(len(hashes), bool)
    for d in range(1, min(reach, len(hashes))):
        again[:-d] |= hashes[:-d] == hashes[d:]
    upto = np.concatenate([[0], np.cumsum(again)])
    inside = upto[np.minimum(starts + lengths + reach - 1, len(hashes))] > upto[starts]
    return 1 + (inside | (lengths > reach)).astype(np.int32)


def _anchors(source: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Runs per anchor."""
    for batch in source:
        keys, ns = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        for text in bytes_of(batch, "text"):
            _, hashes, key, starts, lengths = _runs(text, window, anchor)
            keys.append(key)
            ns.append(_times(hashes, starts, lengths, window - anchor + 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ns))], names=["key", "n"])


SUFFIX = pa.schema(
    [("key", pa.int64()), ("pos_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("heads", pa.list_(pa.int64()))]
)


def _suffixes(source: Iterator[pa.RecordBatch], shared, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Rows of neighbouring suffixes with one anchor.

    ``heads`` has a hash of the first ``window`` words of each. Rows without heads name suffixes of
    which the same task has an earlier occurrence; only suffixes of large groups come so.
    """
    repeated: KeyBitmap
    repeated, hot = shared.value
    hot = hot.view(np.uint64)
    hot.sort()
    first: dict[int, tuple[int, int, int]] = {}
    for batch in source:
        rows: list[tuple] = []
        heads_of: list[np.ndarray] = []
        later: list[tuple[int, int, int]] = []
        ids, text_keys = batch.column("pos_id").to_pylist(), batch.column("text_key").to_pylist()
        for pos_id, text_key, text in zip(ids, text_keys, bytes_of(batch, "text"), strict=True):
            words, _, keys, starts, lengths = _runs(text, window, anchor)
            if not len(keys):
                continue
            hits = np.flatnonzero(repeated.hit(keys))
            if not len(hits):
                continue
            heads = grams(words, window).view(np.int64)
            in_hot = np.isin(keys[hits], hot) if len(hot) else np.zeros(len(hits), bool)
            for run, large in zip(hits.tolist(), in_hot.tolist(), strict=True):
                at, n = int(starts[run]), int(lengths[run])
                if not large:
                    rows.append((int(keys[run]), pos_id, text_key, at, n))
                    heads_of.append(heads[at : at + n])
                    continue
                for i, head in enumerate(heads[at : at + n].tolist(), at):
                    own, known = (pos_id, i, text_key), first.get(head)
                    if known is None or own[:2] < known[:2]:
                        first[head], own = own, known
                    if own is None:
                        continue
                    if own[:2] == first[head][:2]:  # another row at the same place is no earlier one
                        rows.append((head, own[0], own[2], own[1], 1))
                        heads_of.append(np.array([head], np.int64))
                    else:
                        later.append(own)
        if rows:
            yield _suffix_batch(rows, heads_of)
        if later:
            yield _later_batch(later)
    left = [(head, pos_id, text_key, i, 1) for head, (pos_id, i, text_key) in first.items()]
    for at in range(0, len(left), 20_000):
        part = left[at : at + 20_000]
        yield _suffix_batch(part, [np.array([head], np.int64) for head, *_ in part])


def _suffix_batch(rows: list[tuple], heads: list[np.ndarray]) -> pa.RecordBatch:
    keys, ids, text_keys, starts, ns = zip(*rows, strict=True)
    keys = np.array([k & (1 << 64) - 1 for k in keys], np.uint64).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads)))
    plain = [pa.array(c, t) for c, t in zip((keys, ids, text_keys, starts, ns), SUFFIX.types[:5], strict=True)]
    return pa.RecordBatch.from_arrays([*plain, listed], schema=SUFFIX)


def _later_batch(later: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Neighbouring suffixes of one text as one row."""
    later.sort(key=lambda x: (x[0], x[2], x[1]))
    spans: list[list[int]] = []
    for pos_id, i, text_key in later:
        if spans and spans[-1][0] == pos_id and spans[-1][1] == text_key and spans[-1][2] + spans[-1][3] == i:
            spans[-1][3] += 1
        else:
            spans.append([pos_id, text_key, i, 1])
    ids, text_keys, starts, ns = zip(*spans, strict=True)
    columns = [ids, ids, text_keys, starts, ns, [None] * len(ids)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SUFFIX.types, strict=True)], schema=SUFFIX)


def _deep_nodes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the nodes at full depth, but the first of each node, as spans of suffix starts.

    Rows come sorted by group, document and start: the first leaf that reaches a node stays, and
    one group's nodes are held at a time.
    """
    group, nodes = None, {}
    for batch in source:
        out_id, out_key, out_span = [], [], []
        listed = batch.column("heads")
        ends = listed.offsets.to_numpy().tolist()
        heads = listed.values.to_numpy().tolist()
        empty = listed.is_null().to_numpy(zero_copy_only=False).tolist()
        rows = zip(*(batch.column(c).to_pylist() for c in ("key", "pos_id", "text_key", "start", "n")), strict=True)
        for i, (key, pos_id, text_key, start, n) in enumerate(rows):
            if empty[i]:
                out_id.append(pos_id)
                out_key.append(text_key)
                out_span.append(start << 32 | n)
                continue
            if key != group:
                group, nodes = key, {}
            begun = None
            for at, head in enumerate(heads[ends[i] : ends[i + 1]], start):
                own = (pos_id, at)
                if nodes.setdefault(head, own) < own:
                    begun = at if begun is None else begun
                elif begun is not None:
                    out_id.append(pos_id)
                    out_key.append(text_key)
                    out_span.append(begun << 32 | at - begun)
                    begun = None
            if begun is not None:
                out_id.append(pos_id)
                out_key.append(text_key)
                out_span.append(begun << 32 | start + n - begun)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_id, pa.int64()), pa.array(out_key, pa.int64()), pa.array(out_span, pa.int64())], names=["pos_id", "text_key", "span"]
        )


CUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("repeats", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
        ("kept", pa.binary()),
    ]
)


def _cut(source: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in source:
        ns, gone, repeats, kept = [], [], [], []
        for text, spans in zip(bytes_of(batch, "text"), batch.column("spans"), strict=True):
            words = text.split()
            ranges = _merged(spans.values.to_numpy(), window) if spans.is_valid else []
            left, at = [], 0
            for start, end in ranges:
                left += words[at:start]
                at = end
            left += words[at:]
            ns.append(len(words))
            gone.append(len(words) - len(left))
            repeats.append([{"start": s, "length": e - s} for s, e in ranges])
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip((ns, gone, repeats, kept), CUT.types[1:], strict=True))], schema=CUT
        )


def _merged(spans: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows that start in the spans, joined where they touch."""
    out: list[list[int]] = []
    for span in np.sort(spans).tolist():
        start, end = span >> 32, (span >> 32) + (span & 0xFFFFFFFF) + window - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]
