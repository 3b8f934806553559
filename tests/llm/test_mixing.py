import math
from collections import Counter

from larder.llm import mixing


def test_steps_are_the_poisson_distribution(spark):
    for mean in (0.0, 0.3, 1.7, 32.0):
        steps = spark.range(1).select(mixing.poisson_steps(mixing.F.lit(mean)).alias("s")).first()["s"]
        total = 0.0
        for k in range(60):
            total += math.exp(-mean) * mean**k / math.factorial(k)
            assert abs(steps[k] - total) < 1e-12


def test_rates_follow_the_weights(make_docs):
    docs = make_docs([(i, f"t{i}") for i in range(6000)])
    out = mixing.mix(docs, weights={"src0": 3.0, "src1": 1.0}, total=8000).collect()
    n = Counter(r["source"] for r in out)
    assert set(n) == {"src0", "src1"} and abs(n["src0"] - 6000) < 400 and abs(n["src1"] - 2000) < 250
    copies = Counter(r["doc_id"] for r in out)
    for i in range(50):
        assert sorted(r["copy"] for r in out if r["doc_id"] == i) == list(range(1, copies[i] + 1))
    zero = sum(i not in copies for i in range(0, 6000, 3)) / 2000
    assert abs(zero - math.exp(-3)) < 0.02


def test_large_means_are_sums_of_parts(make_docs):
    out = mixing.mix(make_docs([(i, "t") for i in range(0, 60, 3)]), total=20 * 1000).groupBy("doc_id").count().collect()
    assert len(out) == 20 and all(abs(r["count"] - 1000) < 200 for r in out)


def test_tempered_by_default_reruns_the_same_and_shuffles(make_docs):
    rows = [(3 * i, "t") for i in range(4000)] + [(3 * i + 1, "t") for i in range(1000)]
    docs = make_docs(rows)
    first = mixing.mix(docs)
    out = [tuple(r) for r in first.collect()]
    assert out == [tuple(r) for r in mixing.mix(docs.repartition(5)).collect()]
    n = Counter(r[3] for r in out)
    assert abs(n["src0"] / n["src1"] - 2) < 0.25
    ids = [r[0] for r in out]
    assert sum(a < b for a, b in zip(ids, ids[1:])) / len(ids) < 0.6


def test_nulls_repeats_and_clashing_columns(spark, make_docs):
    docs = spark.createDataFrame([(None, None, 1, 2), (1, "s", 3, 4), (1, "s", 5, 6)], "doc_id long, source string, copy int, `a.b` int")
    out = mixing.mix(docs, total=300)
    assert out.columns == ["doc_id", "source", "a.b", "copy", "shuffle_key"]
    n = Counter((r["doc_id"], r["a.b"]) for r in out.collect())
    assert min(n[1, 4], n[1, 6], n[None, 2]) > 50 and n[1, 4] != n[1, 6]
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([(1, "a")]), weights={"other": 1.0}).count() == 0


def test_rows_without_id_and_texts_under_one_id_draw_for_themselves(make_docs, monkeypatch):
    monkeypatch.setattr("larder.llm.shared.EQUAL_ROWS", 300)
    rows = [(None, f"t{i}") for i in range(2000)] + [(7, f"u{i}") for i in range(2000)] + [(None, "same")] * 2000
    docs = make_docs(rows).selectExpr("doc_id", "text", "'s' as source")
    out = mixing.mix(docs).collect()
    for mine in (lambda r: (r["text"] or "")[0] == "t", lambda r: r["doc_id"] == 7, lambda r: r["text"] == "same"):
        assert abs(sum(map(mine, out)) - 2000) < 200
    assert len({r["shuffle_key"] for r in out}) == len(out)
    distinct = len({r["text"] for r in out if r["doc_id"] == 7})
    assert abs(distinct / 2000 - (1 - math.exp(-1))) < 0.05


def test_long_texts(make_docs):
    out = mixing.mix(make_docs([(3, "long " * 200_000)]), total=40).collect()
    assert 15 < len(out) < 70 and all(len(r["text"]) == 1_000_000 for r in out)
