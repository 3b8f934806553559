import random

import numpy as np
import pytest

from larder.llm import benchmark

from .conftest import edit


def smith_waterman(text, target):
    """Best score only, the whole table kept."""
    table = [[0] * (len(target) + 1) for _ in range(len(text) + 1)]
    for i, a in enumerate(text, 1):
        for j, b in enumerate(target, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_alignment_scores_match_the_full_table():
    rng = random.Random(1)
    for _ in range(150):
        text, target = ([rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, matches, start, end = benchmark.align(text, target)
        assert score == smith_waterman(text, target)
        assert smith_waterman(text[start:end], target) == score and matches <= end - start


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_copies_edited_copies_and_clean_texts(spark, make_docs, prose):
    items = [(i, prose(40, 700 + i)) for i in range(6)]
    clean = [prose(200, i) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows.append((100, clean[0] + " " + items[0][1] + " " + clean[1]))
    rows.append((101, clean[2] + " " + edit(items[1][1], 6, 3) + " " + clean[3]))
    rows.append((102, items[2][1].upper().replace(" ", ", ") + "!"))
    words = items[3][1].split()
    rows.append((103, clean[4] + " " + " ".join(words[:20] + ["new", "words"] + words[20:]) + " " + clean[5]))
    rows += [(200 + i, clean[i] + " " + items[4][1]) for i in range(15)]
    docs, tests = make_docs(rows), bench(spark, items)
    out = {(r["doc_id"], r["item_id"]): r for r in benchmark.find_leaks(docs, tests).collect()}
    assert set(out) == {(100, 0), (101, 1), (102, 2), (103, 3), *((200 + i, 4) for i in range(15))}
    assert out[100, 0]["score"] == 1.0 and out[100, 0]["n_matches"] == 40 and out[100, 0]["first_word"] == 200
    assert 0.5 < out[101, 1]["score"] < 1
    kept = benchmark.decontaminate(docs, tests)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(20))


def test_blocks_of_items_give_the_same(spark, make_docs, prose):
    items = [(i, prose(30, 700 + i)) for i in range(5)]
    docs = make_docs([(i, prose(50, i) + " " + t) for i, t in items])
    whole, parts = (sorted(map(tuple, benchmark.find_leaks(docs, bench(spark, items), item_bytes=n).collect())) for n in (1 << 20, 200))
    assert whole == parts and len(whole) == 5


def test_nulls_empties_and_ties(spark, make_docs, prose):
    text = prose(30, 1)
    tests = bench(spark, [(1, text), (1, text), (2, None), (None, text), (3, "two words"), (4, "")])
    docs = make_docs([(5, text), (5, text), (None, text), (6, None), (7, ""), (8, "two words")])
    out = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in benchmark.find_leaks(docs, tests).collect()))
    assert out == sorted([(0, 0), (0, 1), (0, 1)] + 2 * [(5, 0), (5, 1), (5, 1)])
    assert benchmark.find_leaks(make_docs([]), tests).count() == 0
    empty = bench(spark, [])
    assert benchmark.find_leaks(docs, empty).count() == 0 and benchmark.decontaminate(docs, empty).count() == 6


def test_long_text_and_clashing_columns(spark, prose):
    item = prose(40, 1)
    docs = spark.createDataFrame([(1, prose(30_000, 2) + " " + item, 0, "s")], "doc_id long, text string, item_id int, seed string")
    out = benchmark.find_leaks(docs, bench(spark, [(9, item)])).collect()
    assert [(r["doc_id"], r["item_id"], r["first_word"]) for r in out] == [(1, 9, 30_000)]
    assert benchmark.decontaminate(docs, bench(spark, [(9, item)])).columns == docs.columns


def test_words_pushed_into_a_copy_do_not_hide_it(prose):
    words = [f"i{k}" for k in range(100)]
    text = prose(80, 1).split() + [w for k, word in enumerate(words) for w in ([word, f"new{k}"] if k < 97 else [word])] + prose(80, 2).split()
    found = list(benchmark.matches_in(benchmark.plain_words(" ".join(text)), benchmark.Items.of([(1, " ".join(words))], 3), benchmark.DEFAULT))
    assert [f[1] for f in found] == [smith_waterman(text, words) / 200] and found[0][1] > 0.5


def test_random_edits_score_as_in_the_full_table(prose):
    """Whatever has a common trigram and scores enough in the full table is found, with that score."""
    rng, items = random.Random(8), [prose(30, 900 + i, 400).split() for i in range(4)]
    block = benchmark.Items.of([(i, " ".join(w)) for i, w in enumerate(items)], 3)
    hits = misses = 0
    for n in range(120):
        copy = list(items[n % 4])
        for _ in range(rng.randrange(22)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [f"e{rng.randrange(99)}"] * rng.randrange(2)
            copy = copy or ["e"]
        text = prose(rng.randrange(40), n, 400).split() + copy + prose(rng.randrange(40), n + 500, 400).split()
        found = {f[0]: f[1] for f in benchmark.matches_in(benchmark.plain_words(" ".join(text)), block, benchmark.DEFAULT)}
        for i, words in enumerate(items):
            full = smith_waterman(text, words) / 60
            seeded = {tuple(text[k : k + 3]) for k in range(len(text) - 2)} & {tuple(words[k : k + 3]) for k in range(28)}
            assert found.get(i) == (full if full >= 0.5 and seeded else None)
            hits += full >= 0.5 and i in found
            misses += full >= 0.5 and i not in found
    assert hits > 40 and hits / (hits + misses) >= 0.97


@pytest.mark.parametrize("n", [15, 17, 1000])
def test_copies_of_an_edited_item_are_found_however_many(spark, make_docs, prose, n):
    words = [f"q{i}" for i in range(40)]
    edited = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(words))
    tests = bench(spark, [(1, " ".join(words)), (2, prose(40, 700))])
    half = " ".join(prose(40, 700).split()[:20])
    docs = make_docs([(i, f"{prose(30, i)} {edited} {prose(30, n + i)} {half}") for i in range(n)] + [(-1, prose(100, 5))])
    out = benchmark.find_leaks(docs, tests).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(i, k) for i in range(n) for k in (1, 2)]
    assert all(r["score"] >= 0.5 for r in out)
    assert [r["doc_id"] for r in benchmark.decontaminate(docs, tests).collect()] == [-1]


def test_frequent_seeds_all_over_a_long_text(prose):
    """Chained seeds make one wide range; it is cut to the dense stretches, with the score of the full table."""
    rng = random.Random(4)
    target = ["one", "of", "the", *(f"t{i}" for i in range(27))]
    text = [w for _ in range(200) for w in ("one", "of", "the", *(f"w{rng.randrange(99)}" for _ in range(17)))]
    text[800:800] = [w if i % 5 != 4 else "x" for i, w in enumerate(target)]
    items = benchmark.Items.of([(1, " ".join(target))], 3)
    found = list(benchmark.matches_in(benchmark.plain_words(" ".join(text)), items, benchmark.DEFAULT))
    assert [f[1] for f in found] == [smith_waterman(text, target) / 60]
    spans = list(benchmark._stretches(text, frozenset(target), 30, benchmark.DEFAULT))
    assert sum(b - a for a, b in spans) < len(text) / 4 and any(a <= 800 and 830 <= b for a, b in spans)
