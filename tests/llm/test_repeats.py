import random

from larder.llm import repeats

from .brute import cut_repeats


def found(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()}


def corpus(prose):
    rng = random.Random(4)
    passages = [prose(rng.randrange(15, 70), 900 + i) for i in range(5)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 50), i)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng.randrange(0, 20), 10 * i + 7)]
        rows.append((i * 3 % 61, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200 + i, "".join(f"r{i}x{k} " * (18 + (i + k) % 9) for k in range(6))) for i in range(12)]
    rows += [(300 + p, " ".join(f"p{p}y{k % p}" for k in range(20 + 2 * p))) for p in range(1, 16)]
    rows += [(100, "again " * 90), (101, "x y " * 30), (102, rows[0][1]), (103, ""), (104, "one two three")]
    return rows


def test_matches_brute_force(make_docs, prose):
    rows = corpus(prose)
    assert found(repeats.remove_repeats(make_docs(rows).repartition(4))) == cut_repeats(rows)


def test_large_groups_are_split_by_the_whole_window(make_docs, prose, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ROWS", 2)
    rows = corpus(prose)
    assert found(repeats.remove_repeats(make_docs(rows).repartition(4))) == cut_repeats(rows)


def test_a_full_bitmap_costs_no_result(make_docs, prose, monkeypatch):
    monkeypatch.setattr(repeats, "FILTER_BITS", 6)
    rows = corpus(prose)
    assert found(repeats.remove_repeats(make_docs(rows))) == cut_repeats(rows)


def test_spans_cover_what_is_removed(make_docs, prose):
    text = prose(40, 1)
    out = {r["doc_id"]: r["repeats"] for r in repeats.remove_repeats(make_docs([(1, text), (2, "a b " + text + " c")])).collect()}
    assert out[1] == [] and [tuple(x) for x in out[2]] == [(2, 40)]


def test_nulls_repeated_rows_and_shared_ids(make_docs, prose):
    text, other = prose(30, 1), prose(30, 2)
    rows = [(None, text), (1, text), (2, other), (2, other), (2, text), (3, None)]
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(make_docs(rows)).collect())
    # the row without id comes first; equal starts of one document are no earlier occurrence
    assert out == [(0, 30, 0), (1, 30, 30), (2, 30, 0), (2, 30, 0), (2, 30, 30), (3, 0, 0)]


def test_empty_table_long_text_and_clashing_columns(spark, make_docs, prose):
    assert found(repeats.remove_repeats(make_docs([]))) == {}
    long = prose(40_000, 8)
    docs = spark.createDataFrame([(1, long, "k", 5), (2, long, "k", 5)], "doc_id long, text string, key string, spans int")
    assert {d: x[1] for d, x in found(repeats.remove_repeats(docs)).items()} == {1: 0, 2: 40_000}
