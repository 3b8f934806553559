"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. All ``seed``-word n-grams of a test item are its seeds, however frequent: the n-grams that survive
   in a copy that was made often are frequent for that reason.
2. A document that contains a seed of an item is aligned with it around the seeds: match, mismatch
   and gap scores per word, best local alignment. Its score is divided by that of a full copy.
   Stretches with too few of the item's words for the least score are passed over.

Words are lower-cased runs of letters and digits, so case and punctuation do not hide a copy.
The pass is map-only over the documents. Items are broadcast in blocks of at most ``ITEM_BYTES`` of
text, one scan per block.

Rows: null or empty texts match nothing; items of fewer than ``seed`` words have no seed and match
nothing; repeated documents and items each give their own rows; null ids are carried as null; texts of any length
are searched whole; of equal scores in a document the first place counts; an empty table of documents or items
gives no leaks; ``find_leaks`` ignores other columns, ``decontaminate`` carries them, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import batches, column, filtered_in_arrow, union_all
from larder.llm.wordhash import byte_values, grams, word_hashes

ITEM_BYTES = 8 << 20
PLAIN = byte_values(spaces=bytes(b for b in range(128) if not chr(b).isalnum()))


@dataclass(frozen=True)
class Scoring:
    seed: int = 3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    least: float = 0.5  # share of the score of a full copy


DEFAULT = Scoring()


def plain_words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "replace"), PLAIN)


@dataclass
class Items:
    """One block of test items: their words, and where each n-gram stands in them."""

    ids: list
    words: list[list[int]]
    seeds: np.ndarray  # sorted distinct hashes
    places: list[list[tuple[int, int]]]  # per seed: (item, position)
    quick: np.ndarray = field(init=False)  # 2**20 flags that rule out nearly all other n-grams
    sets: list[frozenset[int]] = field(init=False)  # distinct words of each item

    def __post_init__(self):
        self.sets = [frozenset(w) for w in self.words]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, rows: list[tuple], seed: int) -> Items:
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        words = []
        for i, (_, text) in enumerate(rows):
            hashes = plain_words(text)
            words.append(hashes.tolist())
            for at, g in enumerate(grams(hashes, seed).tolist()):
                found[g].append((i, at))
        return cls._from([r[0] for r in rows], words, found)

    @classmethod
    def _from(cls, ids, words, found):
        seeds = np.array(sorted(found), np.uint64)
        return cls(ids, words, seeds, [found[s] for s in seeds.tolist()])

    def hits(self, words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text where a seed stands, and which seed."""
        hashes = grams(words, seed)
        at = np.flatnonzero(self.quick[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        same = self.seeds[which] == hashes[at]
        return at[same], which[same]


def blocks(bench: DataFrame, scoring: Scoring, id_col: str, text_col: str, limit: int) -> Iterator[Items]:
    """Test items in blocks of about ``limit`` bytes, so that each can be broadcast."""
    items = bench.select(column(id_col).cast("long").alias("item_id"), column(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        yield Items.of([(r["item_id"], r["text"]) for r in part.collect()], scoring.seed)


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    scoring: Scoring = DEFAULT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, n_matches, first_word, n_words): best alignment of each leaked item in a document."""
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, n_matches int, first_word int, n_words int"
    parts = [
        texts.mapInArrow(partial(_leaks, shared=shared, scoring=scoring), schema)
        for shared in _shared_blocks(bench, scoring, item_id_col, item_text_col, item_bytes)
    ]
    return union_all(parts) if parts else texts.sparkSession.createDataFrame([], schema)


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    scoring: Scoring = DEFAULT,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no copy of a test item. Map-only: rows stay where they are."""
    for shared in _shared_blocks(bench, scoring, item_id_col, item_text_col, item_bytes):
        docs = filtered_in_arrow(docs, partial(_clean, shared=shared, scoring=scoring), text_col)
    return docs


def _shared_blocks(bench, scoring, id_col, text_col, limit):
    sc = bench.sparkSession.sparkContext
    for items in blocks(bench, scoring, id_col, text_col, limit):
        yield sc.broadcast(items)


LEAK = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32())]
)


def _leaks(source: Iterator[pa.RecordBatch], shared, scoring: Scoring) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value

    def rows():
        for batch in source:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for item, score, matches, start, end in matches_in(plain_words(text), items, scoring):
                    yield doc, items.ids[item], score, matches, start, end - start

    yield from batches(rows(), LEAK)


def _clean(source: Iterator[pa.RecordBatch], shared, scoring: Scoring, text_col: str) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value
    for batch in source:
        texts = batch.column(text_col).to_pylist()
        yield batch.filter(pa.array([next(matches_in(plain_words(t), items, scoring), None) is None for t in texts], pa.bool_()))


def matches_in(words: np.ndarray, items: Items, scoring: Scoring) -> Iterator[tuple[int, float, int, int, int]]:
    """(item, score, matches, start, end) of the items that align well enough with a text."""
    at, which = items.hits(words, scoring.seed)
    starts: dict[int, set[int]] = defaultdict(set)  # where the item would begin
    for pos, s in zip(at.tolist(), which.tolist(), strict=True):
        for item, place in items.places[s]:
            starts[item].add(pos - place)
    for item in sorted(starts):
        target = items.words[item]
        pad = _reach(len(target), scoring)
        best = (0, 0, 0, 0)
        for low, high in _clusters(sorted(starts[item]), len(target)):
            begin = max(0, low - pad)
            near = words[begin : high + len(target) + pad].tolist()
            for first, last in _stretches(near, items.sets[item], len(target), scoring):
                text = near[first:last]
                common = sum((Counter(text) & Counter(target)).values())
                if common < scoring.least * len(target):
                    continue  # not even all common words in order would do
                score, matches, start, end = align(text, target, scoring)
                best = max(best, (score, matches, -(begin + first + start), begin + first + end))
        share = best[0] / (scoring.match * len(target))
        if best[0] and share >= scoring.least:
            yield item, share, best[1], -best[2], best[3]


def _clusters(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Ranges of starts no further apart than ``gap``."""
    low = last = starts[0]
    for s in starts[1:]:
        if s - last > gap:
            yield low, last
            low = s
        last = s
    yield low, last


def _reach(size: int, scoring: Scoring) -> int:
    """Gaps that an alignment of the least score with an item of ``size`` words can afford, and a seed's length."""
    spare = scoring.match * size * (1 - scoring.least)
    return int(spare / -scoring.gap) + scoring.seed if scoring.gap < 0 else size


def _stretches(text: list[int], own: frozenset[int], size: int, scoring: Scoring) -> Iterator[tuple[int, int]]:
    """Ranges of a text that hold every alignment of the least score with an item of ``size`` words.

    Such an alignment has ``least * size`` words of the item, and its gaps cost no more than a full copy has to spare.
    """
    spare = scoring.match * size * (1 - scoring.least)
    width = min(len(text), size + int(spare / -scoring.gap) + 1) if scoring.gap < 0 else len(text)
    if not width:
        return
    sums = np.concatenate([[0], np.cumsum(np.fromiter((w in own for w in text), np.int64, len(text)))])
    dense = np.flatnonzero(sums[width:] - sums[:-width] >= scoring.least * size).tolist()
    for low, high in _clusters(dense, width) if dense else ():
        yield low, high + width


def align(text: list[int], target: list[int], scoring: Scoring = DEFAULT) -> tuple[int, int, int, int]:
    """Best local alignment (Smith-Waterman): score, matched words, start and end in ``text``.

    Of equal scores the first in the text counts.
    """
    match, mismatch, gap = scoring.match, scoring.mismatch, scoring.gap
    best = (0, 0, 0, 0)
    above = [(0, 0, 0)] * (len(target) + 1)  # score, matches, -start
    for i, word in enumerate(text):
        fresh = (0, 0, -i - 1)
        row = [fresh]
        left = fresh
        corner = above[0]
        for j, other in enumerate(target, 1):
            up = above[j]
            if word == other:
                cell = (corner[0] + match, corner[1] + 1, corner[2])
            else:
                cell = (corner[0] + mismatch, corner[1], corner[2])
            if up[0] + gap > cell[0]:
                cell = (up[0] + gap, up[1], up[2])
            if left[0] + gap > cell[0]:
                cell = (left[0] + gap, left[1], left[2])
            if cell[0] <= 0:
                cell = fresh
            elif cell[0] > best[0]:
                best = (cell[0], cell[1], -cell[2], i + 1)
            corner = up
            left = cell
            row.append(cell)
        above = row
    return best
