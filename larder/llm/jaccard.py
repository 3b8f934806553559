"""N-gram Jaccard join: prefix-routed blocks searched by T-occurrence with DivideSkip.

Two documents link when their sets of distinct word shingles have a Jaccard similarity of at
least ``threshold`` (a fraction num/den). The join is exact and goes in four steps:

1. *Order.* A fixed-size sketch counts all shingles of all documents; the order of shingles
   puts those of common passages last. Any order is right, this one keeps lists short.
2. *Route.* Linked sets of sizes n and m share a shingle among the first n - ceil(tn) + 1 of
   each. Postings of these prefixes meet by shingle; the most central posting of a shingle is
   its hub, and the documents that met under a hub form one block. So both ends of every
   link meet in a block.
3. *Hub search.* Every member of a block looks up the hub. Blocks are salted; memory is one set.
4. *Rest.* Members that are not yet known to be connected to their hub are indexed in chunks
   of inverted lists, and all members of the block search these lists. Pairs known to be
   connected are skipped, so a large group of copies costs no pair work.

Before sets travel in steps 3 and 4, each document's bitmap does (two bits per shingle): a bit that
only one of two documents has is a shingle that only it has, which bounds their overlap from
above. Documents that no other of the block can reach stay behind.

A search merges the short lists with a heap and probes the long ones by bisection (DivideSkip).
Sets of equal digest (128 bit) are one node. Shingles are 64-bit hashes, 48 bits of them where
sets are compared.

Rows: null or empty text gives an empty set that links with nothing; rows that share a doc_id
are one document; rows without doc_id are returned with a null component and are linked to nothing.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.shared import KeyBitmap, batches, bytes_of, column, key_bitmap, slot_of, stage
from larder.llm.wordhash import mix, shingle_set

SKETCH_BITS, SLICES = 20, 64
FILTER_BITS = 24
SALT_ROWS, CHUNK_ROWS = 512, 512
LONG_LIST_COST = 0.05  # DivideSkip's mu: price of a probe against that of a merge step


@dataclass(frozen=True)
class Similarity:
    """Jaccard of at least num/den on shingles of ``words`` words."""

    words: int = 5
    num: int = 4
    den: int = 5

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def floor(self, n: int) -> int:
        """Overlap that any partner of a set of size n must reach."""
        return -(-self.num * n // self.den)

    def overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))


DEFAULT = Similarity()


def jaccard_components(docs: DataFrame, sim: Similarity = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary").alias("text"))
    profiled = stage(texts.mapInArrow(partial(_profile, sim=sim), PROFILE_DDL), "jaccard-profile")
    sizes = profiled.filter("slice is null").select("doc_id", "n", "d1", "d2")
    named = sizes.filter("doc_id is not null")
    # staged, so that the join below has a plain exchange on either side and AQE can split a large group of copies
    classes = stage(named.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    rep_of = named.filter("n > 0").join(classes, ["d1", "d2"]).select("doc_id", "rep").distinct()

    bits_of = classes.join(profiled.filter("n > 0").select(F.col("doc_id").alias("rep"), "d1", "d2", "n", "bits"), ["rep", "d1", "d2"])
    bits_of = bits_of.dropDuplicates(["rep", "d1", "d2"]).select(F.col("rep").alias("doc_id"), "n", "bits")
    levels = texts.sparkSession.sparkContext.broadcast(_levels(profiled.filter("slice is not null")))
    members = stage(_members(texts, sim, levels, rep_of), "jaccard-members")
    first = _links(texts, sim, *_hub_blocks(_reachable(*_hub_blocks(members), bits_of, sim)))
    known = components(first)
    rest = _links(texts, sim, *_rest_blocks(members, known, bits_of, sim))
    # rows that share a doc_id with another text tie their classes together
    tied = rep_of.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = components(stage(union_known(known, rest).unionByName(tied), "jaccard-links"))
    own = named.select("doc_id").distinct().join(linked, F.col("doc_id") == F.col("node"), "left")
    found = own.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    return sizes.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(found, "doc_id", "left")


def union_known(known: DataFrame, links: DataFrame) -> DataFrame:
    return known.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(links)


# --- step 1: sizes, digests and the sketch ------------------------------------------------


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    a = mix(s + np.uint64(len(s))).sum(keepdims=True)
    b = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True)
    return int(_signed(mix(a))[0]), int(_signed(mix(b))[0])


PROFILE_DDL = "doc_id long, n int, d1 long, d2 long, bits binary, slice int, counts binary"
PROFILE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int32()),
        ("d1", pa.int64()),
        ("d2", pa.int64()),
        ("bits", pa.binary()),
        ("slice", pa.int32()),
        ("counts", pa.binary()),
    ]
)


def bitmap(s: np.ndarray) -> np.ndarray:
    """At least two bits per shingle, a power of two of them; larger ones fold to smaller by halves."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    at = s & np.uint64(size - 1)
    out = np.zeros(size, np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps folded to ``words`` 64-bit words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _profile(source: Iterator[pa.RecordBatch], sim: Similarity) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    held: list[np.ndarray] = []
    size = 0
    shift = np.uint64(64 - SKETCH_BITS)
    for batch in source:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch, "text"), strict=True):
            s = shingle_set(text, sim.words)
            rows.append((doc, len(s), *_digest(s), bitmap(s).tobytes(), None, None))
            held.append(s >> shift)
            size += len(s)
            if size >= 1 << 20:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                held, size = [], 0
        yield from batches(iter(rows), PROFILE)
    if held:
        counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
    if counts.any():
        parts = counts.reshape(SLICES, -1)
        yield from batches(((None, None, None, None, None, i, parts[i].tobytes()) for i in range(SLICES)), PROFILE)


def _levels(slices: DataFrame) -> np.ndarray:
    """One byte per sketch bucket: 0, or how many doublings it stands out from the mean."""
    summed = slices.select("slice", "counts").repartition(16, "slice").mapInArrow(_sum_slices, "slice int, counts binary")
    total = np.zeros(1 << SKETCH_BITS, np.int64).reshape(SLICES, -1)
    for row in summed.collect():  # SLICES rows of fixed size
        total[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    flat = total.reshape(-1)
    noise = 6 * np.sqrt(flat.mean()) + 4
    over = np.maximum((flat - flat.mean()) / noise, 0.5)
    return np.where(over < 1, 0, 1 + np.floor(np.log2(np.maximum(over, 1)))).astype(np.uint8)


def _sum_slices(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in source:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(counts, np.uint32).astype(np.int64)
            sums[k] = sums[k] + part if k in sums else part
    yield from batches(((k, v.tobytes()) for k, v in sums.items()), pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))


# --- step 2: prefixes meet by shingle -------------------------------------------------------

POSTING = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("rare", pa.int32())])


def _postings(source: Iterator[pa.RecordBatch], sim: Similarity, levels) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(64 - SKETCH_BITS)
    seen: set[tuple[int, int]] = set()
    for batch in source:
        tokens, docs, rares, lengths = [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch, "text"), strict=True):
            s = shingle_set(text, sim.words)
            if not len(s) or (digest := _digest(s)) in seen:
                continue
            seen.add(digest)
            level = levels.value[(s >> shift).astype(np.int64)]
            order = np.argsort(level, kind="stable")  # s is sorted, so ties go by hash
            tokens.append(s[order[: sim.prefix(len(s))]])
            docs.append(doc)
            rares.append(int((level == 0).sum()))
            lengths.append(len(tokens[-1]))
        if docs:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signed(np.concatenate(tokens))),
                    pa.array(np.repeat(np.array(docs, np.int64), lengths)),
                    pa.array(np.repeat(np.array(rares, np.int32), lengths)),
                ],
                schema=POSTING,
            )


def _members(texts: DataFrame, sim: Similarity, levels, rep_of: DataFrame) -> DataFrame:
    """(hub, doc_id): documents that share a prefix shingle with the hub of its list."""
    postings = texts.filter("doc_id is not null").mapInArrow(partial(_postings, sim=sim, levels=levels), "token long, doc_id long, rare int")
    by_token = Window.partitionBy("token").orderBy("rare", "doc_id")
    met = postings.withColumn("hub", F.first("doc_id").over(by_token)).filter("hub <> doc_id").select("hub", "doc_id").distinct()
    met = met.join(rep_of, "doc_id").select("hub", F.col("rep").alias("doc_id"))
    met = met.join(rep_of.withColumnRenamed("doc_id", "hub"), "hub").select(F.col("rep").alias("hub"), "doc_id")
    return met.filter("hub <> doc_id").distinct()


# --- steps 3 and 4: blocks of index rows and probing rows -----------------------------------


def _pieces(count: str, size: int) -> Column:
    return F.ceil(F.col(count) / F.lit(size)).cast("int")


def _part(n: str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")


def _hub_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows: the hub, once per salt. Probing rows: each member, in one salt."""
    salts = members.groupBy("hub").agg(F.count("*").alias("n")).select("hub", _pieces("n", SALT_ROWS).alias("salts"))
    probes = members.join(salts, "hub").select("hub", F.lit(0).alias("chunk"), _part("salts").alias("salt"), "doc_id", F.col("doc_id").alias("label"))
    index = salts.select(
        "hub",
        F.lit(0).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.col("hub").alias("doc_id"),
        F.col("hub").alias("label"),
    )
    return index, probes


def _rest_blocks(members: DataFrame, known: DataFrame, bits_of: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """Blocks of members that may link beyond what is known."""
    of_hub = known.select(F.col("node").alias("hub"), F.col("component").alias("hub_label"))
    of_doc = known.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    labelled = (
        members.join(of_hub, "hub", "left")
        .join(of_doc, "doc_id", "left")
        .select("hub", "doc_id", F.coalesce("hub_label", "hub").alias("hub_label"), F.coalesce("label", "doc_id").alias("label"))
    )
    labelled = stage(labelled, "jaccard-labelled")
    near = _reachable(*_stray_blocks(labelled), bits_of, sim)
    return _stray_blocks(labelled.join(near, ["hub", "doc_id"], "left_semi"))


def _stray_blocks(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows: members not connected to their hub so far, in chunks. Probing rows: the whole block."""
    parts = (
        labelled.groupBy("hub")
        .agg(F.count("*").alias("n"), F.count_if(F.expr("label <> hub_label")).alias("strays"))
        .filter("strays > 0 and n > 1")  # a lone member has been compared with its hub
        .select("hub", _pieces("strays", CHUNK_ROWS).alias("chunks"), _pieces("n", SALT_ROWS).alias("salts"))
    )
    index = (
        labelled.filter("label <> hub_label")
        .join(parts, "hub")
        .withColumn("chunk", _part("chunks"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("hub", "chunk", "salt", "doc_id", "label")
    )
    probes = (
        labelled.join(parts, "hub")
        .withColumn("salt", _part("salts"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("hub", "chunk", "salt", "doc_id", "label")
    )
    return index, probes


def _dealt(index: DataFrame, probes: DataFrame, content: DataFrame) -> DataFrame:
    """Rows with their content, parts of blocks together, index rows first."""
    rows = index.withColumn("role", F.lit(0)).unionByName(probes.withColumn("role", F.lit(1)))
    return rows.join(content, "doc_id").repartition("hub", "chunk", "salt").sortWithinPartitions("hub", "chunk", "salt", "role")


def _reachable(index: DataFrame, probes: DataFrame, bits_of: DataFrame, sim: Similarity) -> DataFrame:
    """(hub, doc_id) of members that, by their bitmaps, may link to another document of the block."""
    dealt = _dealt(index, probes, bits_of).select("hub", "chunk", "salt", "role", "doc_id", "label", "n", "bits")
    return stage(dealt.mapInArrow(partial(_compare_bits, sim=sim), "hub long, doc_id long").distinct(), "jaccard-reachable")


class Bitmaps:
    """Bitmaps of one chunk, by their size."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        by_size: dict[int, list] = {}
        for doc, label, n, data in rows:
            by_size.setdefault(len(data) // 8, []).append((doc, label, n, data))
        self.parts = []
        for words, own in by_size.items():
            bits = np.frombuffer(b"".join(r[3] for r in own), np.uint64).reshape(len(own), words)
            self.parts.append((words, bits, *(np.array([r[i] for r in own], np.int64) for i in range(3))))

    def near(self, sim: Similarity, doc: int, label: int, n: int, data: bytes) -> list[int]:
        """Documents of the chunk with another label whose overlap bound reaches what is required."""
        own = np.frombuffer(data, np.uint64)
        found: list[int] = []
        for words, bits, docs, labels, sizes in self.parts:
            fit = (sizes * sim.den >= n * sim.num) & (n * sim.den >= sizes * sim.num) & (labels != label) & (docs != doc)
            if not fit.any():
                continue
            common = min(words, len(own))
            theirs, mine = folded(bits[fit], common), folded(own, common)
            only_mine = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
            only_theirs = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
            most = np.minimum(n - only_mine, sizes[fit] - only_theirs)
            found += docs[fit][(sim.num + sim.den) * most >= sim.num * (n + sizes[fit])].tolist()
        return found


def _compare_bits(source: Iterator[pa.RecordBatch], sim: Similarity) -> Iterator[pa.RecordBatch]:
    def rows():
        block, waiting, index, seen = None, [], None, set()
        for batch in source:
            keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "chunk", "salt")), strict=True)
            rest = zip(*(batch.column(c).to_pylist() for c in ("role", "doc_id", "label", "n", "bits")), strict=True)
            for key, (role, *row) in zip(keys, rest, strict=True):
                if key != block:
                    block, waiting, index, seen = key, [], None, set()
                if role == 0:
                    waiting.append(row)
                    continue
                if index is None:
                    index = Bitmaps(waiting)
                if near := index.near(sim, *row):
                    for doc in {row[0], *near} - seen:
                        yield key[0], doc
                    seen.update((row[0], *near))

    yield from batches(rows(), pa.schema([("hub", pa.int64()), ("doc_id", pa.int64())]))


def _links(texts: DataFrame, sim: Similarity, index: DataFrame, probes: DataFrame) -> DataFrame:
    """Links (a, b) found in the blocks; texts of documents in no block are not shuffled."""
    needed = index.select("doc_id").unionByName(probes.select("doc_id"))
    wanted = key_bitmap(needed.select(F.xxhash64("doc_id").alias("h")), FILTER_BITS)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    sets = (
        texts.filter("doc_id is not null")
        .withColumn("slot", slot_of(F.xxhash64("doc_id"), FILTER_BITS))
        .mapInArrow(partial(_sets, sim=sim, wanted=shared), "doc_id long, n int, tokens binary")
    )
    blocks = _dealt(index, probes, sets).select("hub", "chunk", "salt", "role", "doc_id", "label", "tokens")
    return blocks.mapInArrow(partial(_search_blocks, sim=sim), "a long, b long").distinct()


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])


def _sets(source: Iterator[pa.RecordBatch], sim: Similarity, wanted) -> Iterator[pa.RecordBatch]:
    bitmap: KeyBitmap = wanted.value

    def rows():
        for batch in source:
            hits = bitmap.hit(batch.column("slot").to_numpy())
            for i in np.flatnonzero(hits).tolist():
                s = shingle_set(batch.column("text")[i].as_py() or b"", sim.words)
                if len(s):
                    yield batch.column("doc_id")[i].as_py(), len(s), pack(s)

    yield from batches(rows(), SETS, 2000)


def pack(s: np.ndarray) -> bytes:
    """The low 48 bits of each shingle."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> list[int]:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).tolist()


class InvertedLists:
    """Inverted lists over the sets of one chunk, and the T-occurrence search on them."""

    def __init__(self, sim: Similarity):
        self.sim = sim
        self.lists: dict[int, list[int]] = {}
        self.docs: list[tuple[int, int, int]] = []  # doc, label, size

    def add(self, doc: int, label: int, tokens: list[int]) -> None:
        at = len(self.docs)
        self.docs.append((doc, label, len(tokens)))
        for t in tokens:
            self.lists.setdefault(t, []).append(at)

    def search(self, tokens: list[int], skip) -> Iterator[int]:
        """Positions of indexed sets that reach the overlap required with ``tokens``.

        ``skip(at)`` names sets that need not be looked at. The longest lists, fewer than the
        required overlap, are left out of the merge and probed for what the merge has found.
        """
        n, lists = len(tokens), [found for t in tokens if (found := self.lists.get(t))]
        floor = self.sim.floor(n)
        if len(lists) < floor:
            return
        lists.sort(key=len)
        n_long = min(floor - 1, int(floor / (LONG_LIST_COST * log2(len(lists[-1])) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        for at, same in groupby(heapq.merge(*short)):
            count = sum(1 for _ in same)
            if count + n_long < floor or skip(at):
                continue
            need, left = self.sim.overlap(n, self.docs[at][2]), n_long
            for found in long:
                if count + left < need:
                    break
                left -= 1
                i = bisect_left(found, at)
                count += i < len(found) and found[i] == at
            if count >= need:
                yield at


def _search_blocks(source: Iterator[pa.RecordBatch], sim: Similarity) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block with index rows first: one chunk of lists is held at a time."""

    def rows():
        block, lists, joined = None, InvertedLists(sim), {}

        def root(x):
            while (up := joined.get(x, x)) != x:
                x = up
            return x

        for batch in source:
            keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "chunk", "salt")), strict=True)
            rest = zip(*(batch.column(c).to_pylist() for c in ("role", "doc_id", "label", "tokens")), strict=True)
            for key, (role, doc, label, data) in zip(keys, rest, strict=True):
                if key != block:
                    block, lists, joined = key, InvertedLists(sim), {}
                tokens = unpack(data)
                if role == 0:
                    lists.add(doc, label, tokens)
                    continue
                for at in lists.search(tokens, lambda i, own=label: root(lists.docs[i][1]) == root(own)):
                    other, other_label, _ = lists.docs[at]
                    joined[root(other_label)] = root(label)
                    yield doc, other

    yield from batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
