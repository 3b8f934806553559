import random
import zlib

import pytest

from larder.llm import merkle, queries

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, unit string, `at` long"


def tree(nodes):
    """(top, siblings of each node from the bottom up, as (before, after))."""
    sides = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % 16
            sides[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])))
        nodes = [brute.sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], sides


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    text = text.translate(brute.LOWER) if lower and text is not None else text
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return brute.sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def expected(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], []
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, sides = tree([leaf(r) for r in by_source[s]])
        tops.append(top)
        inner.append(sides)
    root, over = tree(tops)
    out = []
    for k, s in enumerate(order):
        for r, sides in zip(by_source[s], inner[k], strict=True):
            way = sides + over[k]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf(r, lower=changed)
            for before, after in way:
                h = brute.sha(before + h + after)
            out.append((r[0], leaf(r), tops[k], root, brute.sha("".join(a + b for a, b in way)), h, h == root))
    return sorted(map(repr, out))


@pytest.fixture
def check(spark, tmp_path, monkeypatch):
    def run(rows, blocks=None):
        if blocks:
            monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], blocks))
        spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
        got = queries.op12_merkle_manifest(spark, str(tmp_path))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return sorted(repr(tuple(r)) for r in got.collect()), expected(rows)

    return run


def test_nulls_ties_repeats_long_texts_and_clashing_columns(check):
    rng = random.Random(4)
    rows = [(i, f"Text {i}", "en", f"src{i % 3}", i, "x", "y", 1) for i in range(60)]
    rows += [(None, "No id", "en", "src1", 3, "x", "y", 1), (7, "Other", "en", "src1", 3, None, None, None)]
    rows += [(99, "Same", None, None, None, "x", "y", 1)] * 3 + [(100, None, None, None, None, "x", "y", 1), (101, "", "", "", 0, "x", "y", 1)]
    rows += [(102, "Ünïcode " * 50_000, "de", "\U0001f600", 1, "x", "y", 1), (103, "A", "de", "￿", 1, "x", "y", 1)]
    rng.shuffle(rows)
    got, want = check(rows)
    assert got == want and any("False" in r for r in got)


@pytest.mark.usefixtures("many_ranges")
def test_several_rounds_and_many_sources(check):
    rows = [(i, f"T{i}", "en", "hot" if i % 3 else f"s{i:04}", i, "x", "y", 1) for i in range(900)]
    got, want = check(rows, merkle.Superblocks(1))
    assert got == want


def test_run_of_one_node_is_hashed(check):
    got, want = check([(i, "T", "en", "one", i, "x", "y", 1) for i in range(257)], merkle.Superblocks(1))
    assert got == want


def test_empty_table_and_a_lone_row(check, tmp_path, spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).collect() == []
    got, want = check([(5, "Lone", "en", "a", 4, "x", "y", 1)])
    assert got == want


def test_proof_leads_to_the_root(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 40}", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle.manifest(docs).collect()
    assert {r["folded_root"] for r in out} == {r["root"] for r in out} and len({r["root"] for r in out}) == 1
    assert {r["doc_id"]: r["leaf"] for r in out} == {r[0]: leaf(r) for r in rows}
