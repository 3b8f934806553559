import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, `row` string, position long"


def brute(rows, keep=5):
    """Results of (vec_id, embedding, label) rows, by scoring every pair."""
    taken = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []

    def order(x):
        return -x[0], x[1] is None, x[1] or 0

    for k, (a, label, q) in enumerate(taken):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, other) for j, (i, other, v) in enumerate(taken) if j != k]
        for ps, p, _ in sorted((x for x in scored if x[2] == label), key=order)[:keep]:
            window = sorted((x for x in scored if x[2] != label and 80 * ps <= 100 * x[0] <= 100 * ps), key=order)
            out += [(a, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(window[:keep], 1)]
    return sorted(map(repr, out))


def vectors(n, seed, size=8, labels=3, clusters=6):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(clusters, size))
    return [(i, [float(np.float32(x)) for x in (heads[i % clusters] + rng.normal(size=size) * 0.4) * rng.uniform(0.3, 1.5)], int(rng.integers(labels))) for i in range(n)]


@pytest.fixture
def mined(spark):
    def run(rows):
        df = spark.createDataFrame([(*r, 0.5, "x", 3) for r in rows], SCHEMA).repartition(3)
        out = negatives.mine(df, anchors=F.col("id") % 100 == 0)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        return sorted(repr(tuple(r)) for r in out.collect())

    return run


def test_matches_brute_force_in_many_blocks(mined, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = vectors(900, 1)
    want = brute(rows)
    assert len(want) > 50 and mined(rows) == want


def test_nulls_ties_repeats_and_lengths(mined):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)], i % 2) for i in range(320)]
    rows += [(100, [1.0, 1.0, 1.0], 0)] * 2 + [(None, [2.0, 2.0, 2.0], 0), (None, [2.0, 1.0, 1.0], 1), (None, [2.0, 1.0, 1.0], 1)]
    rows += [(400, None, 1), (401, [1.0, None, 0.0], 1), (402, [math.inf, 0.0, 0.0], 1), (403, [math.nan, 0.0, 0.0], 0), (404, [1.0, 1.0, 1.0], None)]
    rows += [(500, [], 0), (501, [2.0], 1), (502, [1.0] * 5, 1), (600, [0.0, 0.0, 0.0], 1), (900, [2.0, 2.0, 2.0], 7)]
    assert mined(rows) == brute(rows)


def test_one_common_vector(mined, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 100)
    rows = vectors(200, 3) + [(1000 + i, [1.0] * 8, i % 3) for i in range(400)]
    assert mined(rows) == brute(rows)


def test_empty_table_and_no_anchor(mined):
    assert mined([]) == [] and mined([(1, [1.0], 1)]) == [] and mined([(100, [1.0], 1)]) == []


@pytest.mark.parametrize("seed", range(5))
def test_trees_cover_and_searches_skip(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * np.array([v for _, v, _ in vectors(1500, seed, clusters=40)]))
    x[rng.integers(0, 1500, 300)] = x[7]
    radius = float(np.linalg.norm(x, axis=1).max())
    unit = negatives.on_sphere(x, radius)
    order, nodes = negatives.cover_tree(unit)
    assert sorted(order) == list(range(1500))
    for parent, lo, hi, centre, cover in zip(*nodes.values(), strict=True):
        inside = order[lo:hi]
        assert centre in inside and np.arccos(np.clip(unit[inside] @ unit[centre], -1, 1)).max() <= cover
        assert parent < 0 or (nodes["lo"][parent] <= lo and hi <= nodes["hi"][parent])
    place = np.empty(1500, np.int64)
    place[order] = np.arange(1500)
    labels = rng.integers(0, 3, 1500)
    tree = {"n": 1500, "rows": order.astype(np.int64).tobytes(), "ids": order.astype(np.int64).tobytes(), "labels": labels[order].tobytes()}
    tree |= {"vectors": x[order].astype(np.int32).tobytes(), "centre": place[nodes["centre"]].tobytes()}
    tree |= {k: nodes[k].tobytes() for k in ("parent", "lo", "hi", "radius")}
    q = x[:3]
    scores = q @ x.T
    low, high = np.quantile(scores, 0.97, axis=1), np.quantile(scores, 0.99, axis=1)
    windows = negatives._Windows(q, np.full(3, -1), np.full(3, -1), np.arange(3), np.zeros(3, np.int64), low, high, same=False)
    best = negatives._Best(3, 5)
    scored = negatives.search_tree(tree, windows, best, 8, radius)
    assert 0 < scored < 1500
    for k in range(3):
        inside = np.flatnonzero((scores[k] >= low[k]) & (scores[k] <= high[k]))
        want = sorted((-scores[k][i], i) for i in inside)[:5]
        assert [(-s, i) for s, i in zip(best.score[k], best.id[k]) if s > -np.inf] == want
