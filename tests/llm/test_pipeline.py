from pathlib import Path

import pytest

import corpus_pipeline
from larder.llm import quality
from larder.llm.queries import fold_of
from larder.llm.shared import table

from .brute import components

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not there")


def test_each_stage_works_on_all_its_predecessor_kept(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    columns = table(spark, FOLDER, "documents").columns
    assert all(list(r.asDict()) == columns for name in list(kept)[:-1] for r in kept[name][:1])

    whole = table(spark, FOLDER, "documents")
    scores = {r["doc_id"]: r["score"] for r in quality.score(whole, quality.train(whole, table(spark, FOLDER, "labels"), fold_of() != 1)).collect()}
    assert {r["doc_id"] for r in kept["quality"]} == {d for d, s in scores.items() if s >= 0.5}

    groups = components([(r["doc_id"], r["text"]) for r in kept["quality"]])
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(d for d, (_, c) in groups.items() if d == c)

    items = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
    clean = {r["doc_id"] for r in kept["decontaminate"]}
    assert clean <= {r["doc_id"] for r in kept["near_duplicates"]}
    assert all((r["doc_id"] in clean) == (not any(i in r["text"] for i in items)) for r in kept["near_duplicates"])

    mixed = [r["doc_id"] for r in kept["mix"]]
    assert set(mixed) <= clean and abs(len(mixed) - len(clean)) < 5 * len(clean) ** 0.5
    assert sorted(r["doc_id"] for r in kept["shard"]) == sorted(mixed)
    assert sorted(r.asDict()) == sorted([*columns, "shard", "slot"]) if (r := kept["shard"][0]) else False


def test_run_gives_the_rows_of_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 50


def test_rows_without_id_and_repeated_rows(spark, make_docs, prose):
    text = prose(60, 1)
    docs = make_docs([(1, text), (1, text), (2, text), (None, text), (3, prose(60, 2)), (4, None)])
    out = corpus_pipeline.keep_one_of_each(spark, docs, FOLDER).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 3, 4] and out[0].asDict().keys() == set(docs.columns)
    alone = prose(70, 9)
    docs = make_docs([(None, alone), (None, alone), (None, alone + " more"), (None, prose(70, 10)), (5, prose(70, 11))])
    out = corpus_pipeline.keep_one_of_each(spark, docs, FOLDER).collect()
    assert len(out) == 3 and sum(r["text"].startswith(alone) for r in out) == 1


def test_every_stage_on_empty_long_and_clashing_tables(spark, make_docs, prose):
    empty = make_docs([])
    for name, apply in corpus_pipeline.STAGES:
        assert apply(spark, empty, FOLDER).count() == 0, name
    rows = [(i, prose(80, i), "en", "s", 5, "k", 3, "c", "o", i, "d") for i in range(12)] + [(20, prose(30_000, 5), "en", "s", 5, "k", 3, "c", "o", 1, "d")]
    names = "id_and_text string, slot int, _key string, component_id string, number int, `row.x` string"
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    for name, apply in corpus_pipeline.STAGES[1:]:
        out = apply(spark, docs, FOLDER)
        own = [c for c in docs.columns if c != "slot" or name != "shard"]
        assert out.columns == own + (["shard", "slot"] if name == "shard" else []), name
        assert out.where("doc_id = 20").count() > 0 or name == "mix", name
        if name != "mix":
            assert out.count() == 13, name


def test_copies_made_by_the_mix_are_spread(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(5)] * 40)
    out = corpus_pipeline.shard(spark, docs, FOLDER).collect()
    of = {}
    for r in out:
        of.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(s) > 15 for s in of.values())


def test_groups_that_share_an_id_each_keep_a_text(spark, make_docs, prose):
    a, b, c = (prose(60, i) for i in (1, 2, 3))
    near = b + " and some"
    docs = make_docs([(1, a), (2, a), (1, near), (3, b), (1, near), (5, c), (4, c), (6, None), (6, "")])
    out = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.keep_one_of_each(spark, docs, FOLDER).collect())
    assert out == sorted([(1, a), (1, near), (4, c), (6, "")])
