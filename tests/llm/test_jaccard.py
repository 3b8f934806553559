import random

import pytest

from larder.llm import jaccard
from larder.llm.wordhash import shingle_set

from .brute import components, shingles
from .conftest import edit


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def corpus(prose):
    rng = random.Random(5)
    rows, passage = [], prose(30, 99)
    for g in range(12):
        base = prose(rng.randrange(40, 160), g)
        rows += [base, *[edit(base, rng.randrange(0, 4), 100 * g + i) for i in range(rng.randrange(1, 9))]]
    rows += [passage + " " + prose(rng.randrange(5, 60), 500 + i) for i in range(25)]
    rows += ["one two", "ONE two", "two one", "a b c d e", "", "x"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(make_docs, prose):
    rows = corpus(prose)
    assert found(jaccard.jaccard_components(make_docs(rows).repartition(5))) == components(rows)


def test_small_chunks_and_salts_give_the_same(make_docs, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 2)
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 2)
    rows = corpus(prose)
    assert found(jaccard.jaccard_components(make_docs(rows).repartition(3))) == components(rows)


def test_copies_repeated_rows_and_nulls(make_docs, prose):
    text, other = prose(60, 1), prose(60, 2)
    rows = [(7, text), (3, text), (3, text), (5, other), (9, None), (8, ""), (None, text), (4, text.upper())]
    out = jaccard.jaccard_components(make_docs(rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    n = len(shingles(text))
    assert by == {7: {(n, 3)}, 3: {(n, 3)}, 4: {(n, 3)}, 5: {(len(shingles(other)), 5)}, 9: {(0, 9)}, 8: {(0, 8)}, None: {(n, None)}}


def test_one_id_with_two_texts_is_one_document(make_docs, prose):
    a, b = prose(60, 1), prose(60, 2)
    out = jaccard.jaccard_components(make_docs([(2, a), (2, b), (1, a), (5, b)])).collect()
    assert {r["component_id"] for r in out} == {1}


def test_empty_table_and_clashing_columns(spark, make_docs, prose):
    assert found(jaccard.jaccard_components(make_docs([]))) == {}
    long = prose(30_000, 3)
    clash = "doc_id long, text string, token long, n int, component_id string"
    docs = spark.createDataFrame([(1, long, 1, 1, "x"), (2, long + " end", 1, 1, "y")], clash)
    assert {r[1][1] for r in found(jaccard.jaccard_components(docs)).items()} == {1}


@pytest.mark.parametrize("mu", [0.001, 0.05, 5.0])
def test_divide_skip_finds_what_reaches_the_overlap(prose, monkeypatch, mu):
    monkeypatch.setattr(jaccard, "LONG_LIST_COST", mu)
    base = prose(80, 1)
    texts = [edit(base, k % 5, k) for k in range(40)] + [prose(80, 50 + k) for k in range(10)]
    lists = jaccard.InvertedLists(jaccard.DEFAULT)
    for i, t in enumerate(texts):
        lists.add(i, i, jaccard.unpack(jaccard.pack(shingle_set(t.encode()))))
    for t in texts[::7]:
        own = shingles(t)
        want = {i for i, x in enumerate(texts) if len(own & shingles(x)) >= jaccard.DEFAULT.overlap(len(own), len(shingles(x)))}
        assert set(lists.search(jaccard.unpack(jaccard.pack(shingle_set(t.encode()))), lambda at: False)) == want


def test_bitmaps_never_rule_out_a_link(prose):
    rng = random.Random(2)
    texts = []
    for g in range(15):
        base = prose(rng.randrange(6, 400), g)
        texts += [base] + [edit(base + " tail" * rng.randrange(0, 12), rng.randrange(0, 4), g * 10 + i) for i in range(3)]
    sets = [shingle_set(t.encode()) for t in texts]
    index = jaccard.Bitmaps([(i, i, len(s), jaccard.bitmap(s).tobytes()) for i, s in enumerate(sets)])
    for i, s in enumerate(sets):
        near = set(index.near(jaccard.DEFAULT, i, i, len(s), jaccard.bitmap(s).tobytes()))
        for j, other in enumerate(sets):
            if i != j and len(set(s.tolist()) & set(other.tolist())) >= jaccard.DEFAULT.overlap(len(s), len(other)):
                assert j in near
