"""The registered queries against their SQL and against brute force, on the smallest driver tables."""

import hashlib
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from larder.llm import queries  # noqa: E402

from . import brute  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def documents(duck):
    return duck.sql("select doc_id, text from documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, duck, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    names = sorted(df.columns)
    other = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(other.columns) == names
    want = sorted(map(repr, duck.sql(f"select {', '.join(names)} from ({queries.ORACLE_SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_op1_reads_back_the_conversations(spark, duck):
    rows = duck.sql("select conv_id, turn, role, text from conversations").fetchall()
    rows += [(-1, 0, "user", queries.PROBE), (-1, 1, "assistant", queries.PROBE)]
    want = {}
    for conv, _, role, text in sorted(rows):
        own = want.setdefault(conv, ["", ""])
        own[0] += f"{role}\n{text or ''}\n"
        own[1] += (text or "") if role == "assistant" else ""
    out = queries.op1_chat_formatting(spark, str(FOLDER)).collect()
    assert {r["conv_id"]: (r["turns_sha256"], r["loss_sha256"], r["loss_chars"]) for r in out} == {
        c: (brute.sha(a), brute.sha(b), len(b)) for c, (a, b) in want.items()
    }


def test_op3_and_op5_match_brute_force(spark, duck):
    rows = documents(duck)
    out = queries.op3_ngram_jaccard_join(spark, str(FOLDER)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute.components(rows)
    out = queries.op5_substring_dedup(spark, str(FOLDER)).collect()
    want = {d: (n, gone, brute.sha(kept)) for d, (n, gone, kept) in brute.cut_repeats(rows).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == want


def test_op6_finds_the_verbatim_copies(spark, duck):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    want = {(d, i) for d, t in documents(duck) for i, x in items if x in t}
    out = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op6_benchmark_decontamination(spark, str(FOLDER)).collect()}
    assert want and want <= set(out) and all(out[x] == 1.0 for x in want)


def test_op2_finds_the_plain_notices(spark, duck):
    notices = {"MIT License": "mit", "Apache License": "apache", "GNU General Public License": "gpl", "CC BY-NC 4.0": "cc-by-nc", "All rights reserved.": "proprietary"}
    want = {(d, i, f) for d, t in documents(duck) for i, line in enumerate(t.split("\n")) for x, f in notices.items() if x in line}
    out = {(r["doc_id"], r["line"], r["family"]) for r in queries.op2_licence_scan(spark, str(FOLDER)).collect()}
    assert out == want


def test_op8_and_op9_on_held_out_labels(spark, duck):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    for name, said in (("op8_quality_classifier", "predicted"), ("op9_quality_rules", "kept")):
        out = {r["doc_id"]: r.asDict() for r in queries.QUERIES[name](spark, folder).collect()}
        import zlib

        held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1 and not out[d].get("base_failed")]
        assert sum(int(out[d][said]) == truth[d] for d in held) / len(held) >= 0.93, name


def test_op9_counts_match_brute_force(spark, duck):
    out = queries.op9_quality_rules(spark, str(FOLDER)).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in out} == {d: brute.statistics(t) for d, t in documents(duck)}
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_op10_columns_and_law(spark, duck):
    import zlib

    texts = dict(documents(duck))
    out = queries.op10_sharding(spark, str(FOLDER)).collect()
    key = {d: int(hashlib.md5(f"{d}:{t}".encode()).hexdigest()[:15], 16) for d, t in texts.items()}
    size = {d: len(t.encode()) + 16 for d, t in texts.items()}
    total, below, shard = sum(size.values()), 0, {}
    for d in sorted(key, key=key.get):
        shard[d] = below * queries.SHARDS // total
        below += size[d]
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"]) for r in out} == {d: (size[d], zlib.crc32(t.encode()), shard[d]) for d, t in texts.items()}
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}


def test_op11_matches_the_plain_patterns(spark, duck):
    from .test_pii import plain

    out = {r["doc_id"]: r for r in queries.op11_pii(spark, str(FOLDER)).collect()}
    texts = dict(documents(duck))
    assert set(out) == set(texts)
    for d, text in texts.items():
        found = plain(text)
        assert [out[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in found) for k in ("email", "ip", "card", "phone")]
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        assert out[d]["base_sha256"] == brute.sha(written) and set(filter(None, written.split(","))) <= set(out[d]["spans"].split(","))
