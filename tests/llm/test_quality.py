import random

import numpy as np
import pytest

from larder.llm import quality
from larder.llm.queries import fold_of


def texts(prose, n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        good = i % 4 != 0
        t = prose(rng.randrange(30, 120), i, 300)
        if not good:
            t = (" ".join(w + "###" for w in t.split()), t.upper(), " | ".join(t.split()), "spam " * 60)[i // 4 % 4]
        out.append((i, t, int(good)))
    return out


@pytest.fixture
def trained(spark, make_docs, prose):
    rows = texts(prose)
    docs = make_docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels, quality.train(docs, labels, learnable=fold_of() != 1)


def test_held_out_accuracy(spark, trained):
    rows, docs, _, model = trained
    scored = quality.score(docs, model).withColumn("held", fold_of() == 1).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in scored if r["held"]]
    right = sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held)
    assert len(held) > 50 and right / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_fit_does_not_depend_on_how_rows_are_dealt(trained):
    rows, docs, labels, model = trained
    again = quality.train(docs.repartition(7), labels.repartition(3), learnable=fold_of() != 1)
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()} for m in (model, again))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_scores_do_not_see_the_held_out_fold_or_other_columns(spark, trained):
    rows, docs, labels, model = trained
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(fold_of() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    again = quality.train(other, flipped, learnable=fold_of() != 1)
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()} for m in (model, again))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_pooling_in_pieces(prose, monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(quality.VOCABULARY, quality.DIMS)).astype(np.float32)
    text = prose(500, 1).encode()
    whole = quality.pool(text, vectors)
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert np.allclose(whole, quality.pool(text, vectors), atol=1e-5)


def test_nulls_empties_repeats_and_long_texts(spark, make_docs, trained, prose):
    _, _, _, model = trained
    docs = make_docs([(1, None), (1, ""), (None, "word"), (2, prose(50_000, 1)), (3, "x"), (3, "x")])
    out = quality.score(docs, model).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert quality.score(make_docs([]), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_without_labels_of_both_kinds(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, "d e f")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, one)).collect()} == {0.75}
    torn = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, torn)).collect()} == {0.5}


def test_clashing_columns(spark, trained):
    _, _, _, model = trained
    docs = spark.createDataFrame([(1, "a b", 0.5, "f")], "doc_id long, text string, score double, features string")
    assert quality.score(docs, model).columns == ["doc_id", "score"]
    assert quality.keep_good(docs, model, least=0.0).collect() == docs.collect()
