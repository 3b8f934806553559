import random

from pyspark.sql import functions as F

from larder.llm import sharding


def expected(docs, shards):
    """Shards by the exact byte law, from a full sort."""
    rows = sorted(
        (r["k"], r["size"], r["doc_id"]) for r in docs.select("doc_id", sharding.row_key("doc_id", "text").alias("k"), sharding.row_size("text").alias("size")).collect()
    )
    total, out, below = sum(r[1] for r in rows), [], 0
    keys = {}
    for k, size, _ in rows:
        keys.setdefault(k, below)
        below += size
    for k, _, doc in rows:
        out.append((doc or -1, keys[k] * shards // total))
    return sorted(out)


def check(docs, shards):
    out = sharding.shard_by_bytes(docs, shards).collect()
    assert sorted((r["doc_id"] or -1, r["shard"]) for r in out) == expected(docs, shards)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return out


def test_exact_law_and_gapless_slots(make_docs, prose):
    rng = random.Random(1)
    docs = make_docs([(i, prose(rng.randrange(0, 200), i)) for i in range(500)])
    out = check(docs, 7)
    sizes = {}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len((r["text"] or "").encode()) + 16
    mean = sum(sizes.values()) / 7
    assert len(sizes) == 7 and all(abs(s - mean) < 2000 for s in sizes.values())


def test_many_refinements_and_more_shards_than_rows(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 4)
    check(make_docs([(i, "x" * (i % 9)) for i in range(300)]), 13)
    check(make_docs([(i, "x") for i in range(5)]), 11)


def test_one_text_in_a_third_of_the_rows_spreads(make_docs):
    docs = make_docs([(i, "copied text" if i % 3 else f"own {i}") for i in range(900)])
    out = check(docs, 6)
    copies = [sum(r["shard"] == s and r["text"] == "copied text" for r in out) for s in range(6)]
    assert min(copies) > 50


def test_tolerance_ends_early_and_keeps_to_it(make_docs):
    docs = make_docs([(i, "x" * 100) for i in range(1000)])
    keyed = docs.select(sharding.row_key("doc_id", "text").alias("key"), sharding.row_size("text").alias("size"))
    exact, total = sharding.find_splitters(keyed, 4)
    near, _ = sharding.find_splitters(keyed, 4, tolerance=total // 20)
    for s, (a, b) in enumerate(zip(exact, near), 1):
        below = keyed.filter(F.col("key") < b).agg(F.sum("size")).first()[0]
        assert a <= b and abs(below - s * total / 4) <= total / 20


def test_nulls_repeated_rows_and_other_columns(spark):
    rows = [(1, "a", 5, None, 9)] * 3 + [(None, None, 6, "k", 1), (None, "b", 7, "k", 2), (2, "", 8, "k", 3), (3, "é" * 100_000, 9, "k", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, key string, `piece.x` int")
    out = sharding.shard_by_bytes(docs, 3).collect()
    assert sorted(map(repr, (r["doc_id"] for r in out))) == sorted(repr(r[0]) for r in rows)
    assert sharding.shard_by_bytes(docs, 3).columns == ["doc_id", "text", "key", "piece.x", "shard", "slot"]


def test_equal_rows_spread_over_the_shards(make_docs, monkeypatch):
    monkeypatch.setattr("larder.llm.shared.EQUAL_ROWS", 500)
    docs = make_docs([(5, "the same row")] * 2000 + [(100 + i, "another row.") for i in range(2000)] + [(None, "no id")] * 500)
    out = sharding.shard_by_bytes(docs, 8).collect()
    assert len(out) == 4500
    sizes, same, slots = {}, {}, {}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(r["text"]) + 16
        same[r["shard"]] = same.get(r["shard"], 0) + (r["doc_id"] == 5)
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) <= 28 for s in sizes.values()) and min(same.values()) > 150
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_long_texts_and_ties(make_docs):
    docs = make_docs([(i, "x" * 500_000) for i in range(6)] + [(10 + i, "y") for i in range(60)])
    out = check(docs, 6)
    assert len(out) == 66


def test_empty_table(make_docs):
    assert sharding.shard_by_bytes(make_docs([]), 4).count() == 0
