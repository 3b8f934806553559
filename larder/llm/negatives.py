"""Hard negatives by inner product, searched with cover trees over norm-augmented vectors.

An anchor's positives are the rows of its label with the highest inner products; the hard negatives of a positive
are the rows of other labels whose score lies in a window below the positive's.

Vectors get one more component, sqrt(M**2 - |x|**2), with M the largest norm, so that all lie on a sphere of radius M
and an inner product with a query (last component 0) depends on the angle alone. Every row is put into the cell of
its nearest pivot; pivots are spread by farthest-first choice over a bounded sample (``SAMPLE`` rows by hash, they
decide speed alone). Cells are cut by a row hash into blocks of about ``BLOCK`` rows, and a task builds a cover tree of each block: the
children of a node are members chosen farthest-first until they cover it at half its radius (or ``FAN`` of them
are chosen), and each node keeps the exact angle that covers its members. For a query at angle t from a
node's centre and a covering angle r, all inner products lie between |q| M cos(t + r) and |q| M cos(t - r).

Anchors are taken in blocks of ``ANCHORS`` rows, whose size bounds what is broadcast and collected. In each pass
every task walks the trees of its partition best-first, by the highest bound; nodes whose bounds lie outside the
anchors' windows, or below what an anchor has found already, are skipped, and the leaves that remain are scored with whole numbers. So
results are exact. A task sends at most the wanted number of rows per anchor (and positive) on, and these are
ranked per anchor. Candidates stay in place; only these few rows are shuffled.

Rows: a null label, a null vector, a null, infinite or NaN component takes a row out, and so does a component beyond
2**26 after scaling (its scores would not fit in a long). Shorter vectors count as filled up with zeros. Null
ids are never anchors and come last among ties; rows with equal ids are rows of their own, as candidates, positives and anchors.
Ties go to the smaller id. A table without anchors gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.shared import column, stage
from larder.operators.positions import with_positions
from larder.session import staged_dir

SAMPLE, PIVOTS = 2048, 256
BLOCK, LEAF, FAN = 4096, 64, 16
ANCHORS = 4096
LIMIT = 1 << 26
NO_ID = np.iinfo(np.int64).max
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "anchor long, slot int, score long, id long, row long"


def whole_vectors(rows: DataFrame, scale: float, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(row, id, label, vec): rows that take part, components scaled and rounded down."""
    taken = rows.select(column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), column(vec_col).cast("array<double>").alias("v"))
    taken = taken.filter("label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= LIMIT)))
    vec = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("int"))
    return taken.select(F.monotonically_increasing_id().alias("row"), "id", "label", vec.alias("vec"))


# --- cover trees ---


def matrix(vectors, size: int) -> np.ndarray:
    """Rows of ``size`` components, short ones filled up with zeros."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def on_sphere(x: np.ndarray, radius: float) -> np.ndarray:
    """Unit vectors of the norm-augmented rows."""
    rest = np.sqrt(np.maximum(radius**2 - (x**2).sum(1), 0))
    whole = np.c_[x, rest] / (radius or 1.0)
    norms = np.linalg.norm(whole, axis=1)
    return whole / np.where(norms > 0, norms, 1)[:, None]


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def spread(unit: np.ndarray, most: int, cover: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres until all rows lie within ``cover`` of one: (centres, nearest centre, angle to it)."""
    centres, nearest = [0], np.zeros(len(unit), np.int64)
    apart = angles(unit @ unit[0])
    while len(centres) < most:
        far = int(apart.argmax())
        if apart[far] <= max(cover, 1e-7):
            break
        angle = angles(unit @ unit[far])
        closer = angle < apart
        nearest[closer], apart = len(centres), np.minimum(apart, angle)
        centres.append(far)
    return centres, nearest, apart


def cover_tree(unit: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the rows, nodes): a node holds the rows lo to hi of that order; children follow their parent."""
    order = np.arange(len(unit))
    nodes: list[list] = [[-1, 0, len(unit), 0, 0.0]]  # parent, lo, hi, row of the centre, covering angle
    nodes[0][4] = float(angles(unit @ unit[0]).max())
    at = 0
    while at < len(nodes):
        _, lo, hi, centre, radius = nodes[at]
        if hi - lo > LEAF and radius > 1e-7:
            mine = order[lo:hi]
            first = int(np.flatnonzero(mine == centre)[0])
            mine[0], mine[first] = mine[first], mine[0]
            centres, nearest, apart = spread(unit[mine], FAN, radius / 2)
            rows = [int(mine[c]) for c in centres]
            by_child = np.argsort(nearest, kind="stable")
            order[lo:hi] = mine[by_child]
            bounds = np.searchsorted(nearest[by_child], np.arange(len(centres) + 1))
            if len(centres) > 1:
                for k, row in enumerate(rows):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    nodes.append([at, lo + a, lo + b, row, float(apart[by_child[a:b]].max())])
        at += 1
    table = np.array([n[:4] for n in nodes], np.int64)
    return order, {"parent": table[:, 0], "lo": table[:, 1], "hi": table[:, 2], "centre": table[:, 3], "radius": np.array([n[4] for n in nodes]) + 1e-6}


_TREE = "block long, n int, rows binary, ids binary, labels binary, vectors binary, parent binary, lo binary, hi binary, centre binary, radius binary"


def _built(size: int, radius: float):
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        x = matrix(frame["vec"].tolist(), size)
        order, nodes = cover_tree(on_sphere(x, radius))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes["centre"] = place[nodes["centre"]]
        blobs = [a[order].tobytes() for a in (*[frame[c].to_numpy(np.int64) for c in ("row", "id", "label")], x.astype(np.int32))]
        out = [int(frame["block"].iloc[0]), len(order), *blobs, *[nodes[k].tobytes() for k in ("parent", "lo", "hi", "centre", "radius")]]
        return pd.DataFrame([out], columns=[c.split()[0] for c in _TREE.split(", ")])

    return build


def index(vectors: DataFrame, size: int, radius: float, count: int) -> DataFrame:
    """One row per block of at most about ``BLOCK`` rows: its rows in the order of its cover tree, and the tree."""
    spark = vectors.sparkSession
    share = min(1.0, 2 * SAMPLE / max(count, 1))
    drawn = F.pmod(F.xxhash64(F.lit("pivot"), "row"), F.lit(1 << 30))
    sample = vectors.filter(drawn < int(share * (1 << 30))).select(drawn.alias("draw"), "vec").limit(4 * SAMPLE).toArrow()
    picked = [v for _, v in sorted(zip(sample["draw"].to_pylist(), sample["vec"].to_pylist(), strict=True))[:SAMPLE]] or [[]]
    unit = on_sphere(matrix(picked, size), radius)
    pivots = unit[spread(unit, min(PIVOTS, -(-2 * count // BLOCK)))[0]]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = on_sphere(matrix(batch.column("vec").to_pylist(), size), radius)
            cell = (x @ pivots.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    celled = stage(vectors.mapInArrow(cells, "row long, id long, label long, vec array<int>, cell int"), "negatives-cells")
    sizes = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row per pivot
    first, parts = {}, 0
    for cell, n in sorted(sizes.items()):
        first[cell] = (parts, -(-n // BLOCK))
        parts += first[cell][1]
    listed = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("parts")) for a, b in (first.get(c, (0, 1)) for c in range(len(pivots)))])
    cut = F.get(listed, F.col("cell"))
    block = (cut["first"] + F.pmod(F.xxhash64(F.lit("block"), "row"), cut["parts"])).cast("long")
    blocked = celled.select(block.alias("block"), "row", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "label", "vec")
    trees = blocked.repartition(max(1, min(parts, max(1000, parts // 16))), "block").groupBy("block").applyInPandas(_built(size, radius), _TREE)
    return stage(trees, "negatives-index")


# --- search ---


class _Best:
    """The best ``k`` rows of each query seen so far: by score, then smaller id, then row."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), NO_ID)
        self.row = np.full((queries, k), NO_ID)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows with their scores (queries x rows, -inf where a row is none of the query's)."""
        better = ((scores >= self.least[queries][:, None]) & (scores > -np.inf)).any(1)
        q, s = queries[better], scores[better]
        if not len(q):
            return
        k = self.score.shape[1]
        score = np.c_[self.score[q], s]
        id_ = np.c_[self.id[q], np.broadcast_to(ids, s.shape)]
        row = np.c_[self.row[q], np.broadcast_to(rows, s.shape)]
        top = np.lexsort((row, id_, -score), axis=1)[:, :k]
        for mine, new in ((self.score, score), (self.id, id_), (self.row, row)):
            mine[q] = np.take_along_axis(new, top, 1)

    def found(self, anchor: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
        q, k = np.nonzero(self.score > -np.inf)
        ids = pa.array(self.id[q, k], mask=self.id[q, k] == NO_ID)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[q]), pa.array(slot[q].astype(np.int32)), pa.array(self.score[q, k].astype(np.int64)), ids, pa.array(self.row[q, k])],
            names=["anchor", "slot", "score", "id", "row"],
        )


class _Windows:
    """Queries of a pass: anchor vectors, and for each query its anchor, the scores it wants and whether labels must agree."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray, of: np.ndarray, slot: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool):
        self.vectors, self.labels, self.rows = vectors, labels, rows
        self.of, self.slot, self.low, self.high, self.same = of, slot, low, high, same
        self.norms = np.linalg.norm(vectors, axis=1)


def _leaf(windows: _Windows, best: _Best, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
    """Score rows exactly for the queries that may want them."""
    anchors, at = np.unique(windows.of[queries], return_inverse=True)
    q = windows.vectors[anchors]
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2**53:
        scores = q @ x.T  # whole numbers, exact in doubles
    else:
        scores = (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.float64)
    agree = windows.labels[anchors][:, None] == labels[None, :]
    agree &= windows.rows[anchors][:, None] != rows[None, :]
    if not windows.same:
        agree = windows.labels[anchors][:, None] != labels[None, :]
    scores = np.where(agree, scores, -np.inf)[at]
    inside = (scores >= windows.low[queries][:, None]) & (scores <= windows.high[queries][:, None])
    best.offer(queries, np.where(inside, scores, -np.inf), ids, rows)


def search_tree(tree: dict, windows: _Windows, best: _Best, size: int, radius: float) -> int:
    """Walk one tree best-first for all queries; gives the number of rows scored."""
    x = np.frombuffer(tree["vectors"], np.int32).reshape(tree["n"], size).astype(np.float64)
    rows, ids, labels, parent, lo, hi, centre = (np.frombuffer(tree[k], np.int64) for k in ("rows", "ids", "labels", "parent", "lo", "hi", "centre"))
    cover = np.frombuffer(tree["radius"], np.float64)
    unit = on_sphere(x[centre], radius)[:, :-1]
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent.tolist()):
        children.setdefault(p, []).append(i)
    slack = 1e-6 * windows.norms * radius + 0.5

    def bounds(some: list[int], queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        anchors, at = np.unique(windows.of[queries], return_inverse=True)
        norms = windows.norms[anchors]
        t = angles((windows.vectors[anchors] @ unit[some].T) / np.where(norms > 0, norms, 1)[:, None])
        reach = (norms * radius)[:, None]
        top = reach * np.cos(np.maximum(t - cover[some], 0)) + slack[anchors][:, None]
        low = reach * np.cos(np.minimum(t + cover[some], np.pi)) - slack[anchors][:, None]
        return top[at], low[at]

    heap: list[tuple] = []

    def push(some: list[int], queries: np.ndarray) -> None:
        top, low = bounds(some, queries)
        want = (top >= np.maximum(windows.low, best.least)[queries][:, None]) & (low <= windows.high[queries][:, None])
        for k, node in enumerate(some):
            mine = want[:, k]
            if mine.any():
                heapq.heappush(heap, (-float(top[mine, k].max()), node, queries[mine], top[mine, k]))

    scored = 0
    push([0], np.arange(len(windows.of)))
    while heap:
        _, node, queries, top = heapq.heappop(heap)
        queries = queries[top >= best.least[queries]]  # what was found since may rule the node out
        if not len(queries):
            continue
        if node in children:
            push(children[node], queries)
            continue
        for a in range(lo[node], hi[node], LEAF):
            b = min(a + LEAF, hi[node])
            _leaf(windows, best, queries, x[a:b], ids[a:b], labels[a:b], rows[a:b])
            scored += b - a
    return scored


def _searched(trees: DataFrame, windows: _Windows, k: int, size: int, radius: float) -> DataFrame:
    """The best ``k`` rows of each query: (anchor, slot, score, id, row, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(windows.of), k)
        for batch in batches:
            for i in range(batch.num_rows):
                search_tree({c: batch.column(c)[i].as_py() for c in batch.schema.names}, windows, best, size, radius)
        yield best.found(windows.rows[windows.of], windows.slot)

    ranked = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return trees.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchors`` holds.

    ``anchors`` is a condition on ``id`` and ``label``. Negatives lie between ``low_percent`` and ``high_percent`` of the positive's score.
    """
    spark = rows.sparkSession
    vectors = stage(whole_vectors(rows, scale, id_col, label_col, vec_col), "negatives-vectors")
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    count, size, longest = vectors.agg(F.count("*"), F.max(F.size("vec")), F.max(F.sqrt(square.cast("double")))).first()
    size, radius = max(size or 0, 1), float(longest or 0.0)
    asked = with_positions(vectors.filter(anchors & F.col("id").isNotNull()), ["row"], "position")
    total = asked.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    trees = index(vectors, size, radius, count)
    path = f"{staged_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for i in range(-(-total // ANCHORS)):
        some = asked.filter((F.col("position") >= i * ANCHORS) & (F.col("position") < (i + 1) * ANCHORS)).select("row", "id", "label", "vec").toArrow()
        q, labels, at = matrix(some["vec"].to_pylist(), size), some["label"].to_numpy(), some["row"].to_numpy()
        n = len(at)
        wide = np.full(n, np.inf)
        near = _Windows(q, labels, at, np.arange(n), np.zeros(n, np.int64), -wide, wide, same=True)
        # at most ``positives`` rows for each anchor of the block
        found = _searched(trees, near, positives, size, radius).select("anchor", "rank", "id", "score").toArrow()
        place = {r: k for k, r in enumerate(at.tolist())}
        of = np.array([place[r] for r in found["anchor"].to_pylist()], np.int64)
        score = found["score"].to_numpy()
        low, high = -(-score * low_percent // 100), score * high_percent // 100
        far = _Windows(q, labels, at, of, found["rank"].to_numpy().astype(np.int64), low.astype(float), high.astype(float), same=False)
        hits = _searched(trees, far, negatives, size, radius) if len(of) else spark.createDataFrame([], FOUND + ", rank int")
        ids = some["id"].to_pylist()
        pairs = [(a, slot, ids[place[a]], p, v) for a, slot, p, v in zip(*[c.to_pylist() for c in found.columns], strict=True)]
        of_pair = spark.createDataFrame(pairs, "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        out = hits.join(F.broadcast(of_pair), ["anchor", "slot"])  # one block of anchors
        out = out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("error").parquet(f"{path}/part={i}")
    return spark.read.schema(RESULT).parquet(*[f"{path}/part={i}" for i in range(-(-total // ANCHORS))])
