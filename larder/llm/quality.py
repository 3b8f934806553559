"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

*Random indexing.* Every word has a fixed sparse ternary index vector (by hash bucket). Its word
vector is the sum of the index vectors of the words around it in the training texts. Beside each
word stands its shape (letters, capitals, digits and signs, runs collapsed), which has vectors of
the same kind, so unseen words still carry how they are written.
*Pooling.* A document is the mean word vector, the mean shape vector, the norms of both, how
alike neighbouring vectors are, how often the index vectors of words one and two apart are the same,
and the logarithm of its length. The whole text counts.
*Network.* One hidden layer, trained with Adam in numpy on the driver, on at most ``rows`` labelled
documents; a temperature is fitted on documents the network has not seen. Vectors are integer sums,
so the fit does not depend on how the rows were dealt.

Labels, language, source and id never enter a score. Rows: null and empty texts have a score too
(that of an empty text); documents labelled both ways are left out of training; without labels of both
kinds the score is the share of good ones, or 0.5 without any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import bytes_of, column, filtered_in_arrow, stage
from larder.llm.wordhash import byte_values, word_hashes

DIMS, REACH = 32, 2
WORD_BITS, SHAPE_BITS = 15, 12
WORDS = 1 << WORD_BITS
VOCABULARY = WORDS + (1 << SHAPE_BITS)
N_FEATURES = 2 * DIMS + 7
CHUNK = 1 << 16  # words pooled at once


@dataclass(frozen=True)
class Training:
    rows: int = 12_000  # labelled documents at most, half of them of either label where there are as many
    hidden: int = 32
    steps: int = 600
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 7


DEFAULT = Training()


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """Four entries of +1 or -1 in each vector."""
    rng = np.random.default_rng(11)
    out = np.zeros((VOCABULARY, DIMS), np.int32)
    for _ in range(4):
        out[np.arange(VOCABULARY), rng.integers(0, DIMS, VOCABULARY)] = rng.choice([-1, 1], VOCABULARY)
    return out


def _shape_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for low, high, to in (("a", "z", "a"), ("A", "Z", "A"), ("0", "9", "0")):
        table[ord(low) : ord(high) + 1] = ord(to)
    table[128:] = ord("a")
    return table


SHAPE, VALUES = _shape_bytes(), byte_values()


def units(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vector numbers of the words of a text and of their shapes."""
    words = word_hashes(text, VALUES)
    raw = SHAPE[np.frombuffer(text, np.uint8)]
    kept = raw[np.concatenate([[True], raw[1:] != raw[:-1]])] if len(raw) else raw
    shapes = word_hashes(kept.tobytes(), VALUES)
    return (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), WORDS + (shapes >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)


# --- word vectors ------------------------------------------------------------------------


def _contexts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors, a row per vector that was met."""
    total = np.zeros((VOCABULARY, DIMS), np.int64)
    index = index_vectors()
    for batch in source:
        for text in bytes_of(batch, "text"):
            words, shapes = units(text)
            for at in range(0, len(words), CHUNK):
                low, high = max(0, at - REACH), min(len(words), at + CHUNK + REACH)
                own = index[words[low:high]] + index[shapes[low:high]]
                padded = np.pad(own, ((REACH, REACH), (0, 0)))
                near = sum(padded[j : j + len(own)] for j in range(2 * REACH + 1) if j != REACH)
                inner = slice(at - low, at - low + min(CHUNK, len(words) - at))
                for ids in (words, shapes):
                    _add(total, ids[low:high][inner], near[inner])
    met = np.flatnonzero(total.any(axis=1))
    rows = [pa.array(met.astype(np.int32)), pa.array([v.tobytes() for v in total[met]], pa.binary())]
    yield pa.RecordBatch.from_arrays(rows, names=["unit", "vector"])


def _add(total: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
    total[ids[order][starts]] += np.add.reduceat(rows[order], starts)


def word_vectors(texts: DataFrame, tasks: int = 4) -> np.ndarray:
    """Unit word vectors; each of ``tasks`` tasks sends at most one fixed-size table."""
    total = np.zeros((VOCABULARY, DIMS), np.int64)
    parts = texts.select("text").repartition(tasks).mapInArrow(_contexts, "unit int, vector binary").toArrow()
    for batch in parts.to_batches():
        ids = batch.column("unit").to_numpy()
        if len(ids):
            rows = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int64).reshape(-1, DIMS)
            np.add.at(total, ids, rows)
    norms = np.sqrt((total.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (total / np.maximum(norms, 1)).astype(np.float32)


def pool(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Features of a document."""
    words, shapes = units(text)
    n = len(words)
    out = np.zeros(N_FEATURES, np.float64)
    if not n:
        return out
    sums, alike = np.zeros((2, DIMS)), np.zeros(2)
    for k, ids in enumerate((words, shapes)):
        last = None
        for at in range(0, n, CHUNK):
            rows = vectors[ids[at : at + CHUNK]]
            sums[k] += rows.sum(axis=0, dtype=np.float64)
            alike[k] += float(np.einsum("ij,ij->", rows[1:], rows[:-1])) + (float(last @ rows[0]) if last is not None else 0)
            last = rows[-1]
    means = sums / n
    out[: 2 * DIMS] = means.ravel()
    same = [float((words[d:] == words[:-d]).mean()) if n > d else 0.0 for d in (1, 2)]
    out[2 * DIMS :] = (*np.sqrt((means**2).sum(axis=1)), *(alike / max(n - 1, 1)), *same, np.log1p(n) / 10)
    return out


# --- network ---------------------------------------------------------------------------


@dataclass
class Network:
    """Two layers over standardised features, and a temperature. ``prior`` alone if nothing could be learned."""

    prior: float
    layers: tuple | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    shift: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, fresh: np.ndarray, share: float, plan: Training = DEFAULT) -> Network:
    """Train on the rows not ``fresh``, fit the temperature on those that are.

    ``share``: share of label 1 among all labelled documents, which the sample need not have.
    """
    if len(set(y[~fresh].tolist())) < 2:
        return Network(prior=share)
    net = Network(prior=share, mean=x[~fresh].mean(axis=0), scale=x[~fresh].std(axis=0) + 1e-3)
    rng = np.random.default_rng(plan.seed)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], plan.hidden)), np.zeros(plan.hidden), rng.normal(0, 0.2, plan.hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, t = (x[~fresh] - net.mean) / net.scale, y[~fresh]
    for step in range(1, plan.steps + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(z @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - t) / len(t)
        back = np.outer(error, w2) * (1 - h * h)
        grads = [z.T @ back + plan.decay * w1, back.sum(axis=0), h.T @ error + plan.decay * w2, error.sum(keepdims=True)]
        rate = plan.rate * min(1.0, 2 * (1 - step / (plan.steps + 1)))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.layers = tuple(params)
    if len(set(y[fresh].tolist())) == 2:
        raw, t = net.logits(x[fresh]), y[fresh]
        grid = np.exp(np.linspace(-2, 3, 101))
        losses = [np.mean(np.logaddexp(0, raw / g) - t * raw / g) for g in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
    sampled = float(y.mean())
    net.shift = float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return net


# --- jobs ------------------------------------------------------------------------------


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, learnable=None, plan: Training = DEFAULT) -> Classifier:
    """Fit on documents (doc_id, text) and labels (doc_id, quality 0 or 1).

    ``learnable``: condition on doc_id that a labelled row must meet to be seen at all.
    """
    marked = labels.select(column("doc_id").cast("long").alias("doc_id"), column("quality").alias("quality"))
    marked = marked.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if learnable is not None:
        marked = marked.filter(learnable)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).filter("quality = top").drop("top")
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Classifier(np.zeros((VOCABULARY, DIMS), np.float32), Network(prior=0.5))
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    half = plan.rows // 2
    # two small sorts of at most ``rows`` ids in all; the rest of the labels never leaves its task
    picked = [marked.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    texts = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("binary").alias("text"))
    sample = stage(texts.join(F.broadcast(chosen), "doc_id"), "quality-sample")  # at most ``rows`` ids are broadcast
    vectors = word_vectors(sample.filter(F.pmod(F.crc32(F.concat(F.lit("v"), F.col("doc_id").cast("string"))), F.lit(4)) != 0))
    shared = sample.sparkSession.sparkContext.broadcast(vectors)
    pooled = sample.mapInArrow(partial(_pooled, shared=shared), "doc_id long, quality int, features binary").toArrow().sort_by("doc_id")
    if not pooled.num_rows:
        return Classifier(vectors, Network(prior=share))
    x = np.frombuffer(b"".join(pooled.column("features").to_pylist()), np.float64).reshape(-1, N_FEATURES)
    ids = pooled.column("doc_id").to_pylist()
    fresh = np.array([zlib.crc32(f"v{i}".encode()) % 4 == 0 for i in ids])
    return Classifier(vectors, fit(x, pooled.column("quality").to_numpy().astype(float), fresh, share, plan))


def _pooled(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in source:
        features = [pool(t, shared.value).tobytes() for t in bytes_of(batch, "text")]
        arrays = [batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(features, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "quality", "features"])


def _scores(texts: list[bytes], model: Classifier) -> np.ndarray:
    if not texts:
        return np.empty(0)
    if model.network.layers is None:
        return np.full(len(texts), model.network.prior)
    return model.network.score(np.stack([pool(t, model.vectors) for t in texts]))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of label 1 for each row of ``docs``, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(partial(_scored, shared=shared), "doc_id long, score double")


def _scored(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in source:
        scores = _scores(bytes_of(batch, "text"), shared.value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def keep_good(docs: DataFrame, model: Classifier, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, with a score of at least ``least``. Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered_in_arrow(docs, partial(_good, shared=shared, least=least), text_col)


def _good(source: Iterator[pa.RecordBatch], shared, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    for batch in source:
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(text_col).to_pylist()]
        yield batch.filter(pa.array(_scores(texts, shared.value) >= least))
