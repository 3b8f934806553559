import random

from larder.llm import rules
from larder.llm.queries import fold_of

from .brute import statistics

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_match_brute_force(spark, make_docs, prose):
    rng = random.Random(2)
    texts = ["", None, "a", "a b", "a b c", "a b c a b c", "x " * 40, "é#*$ %&\n\n \t\né#*$ %&\n|<>", "\x0b \x0c", "l\nl\n\nl \nl"]
    texts += ["\n".join(rng.choice(["the same line again", prose(6, i, 12), "a | b"]) for _ in range(rng.randrange(1, 30))) for i in range(40)]
    texts.append(prose(20_000, 5, 50))
    found = rules.text_statistics(make_docs(list(enumerate(texts)))).select("doc_id", *COUNTS).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {i: statistics(t) for i, t in enumerate(texts)}


def labelled(spark, make_docs, prose):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        t = prose(rng.randrange(60, 120), i)
        if i % 5 == 0:
            t = (t.upper().replace(" ", "!! "), " ".join(w + "###" for w in t.split()))[i // 5 % 2]
        rows.append((i, t, int(i % 5 != 0)))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    return rows, rules.text_statistics(make_docs([(i, t) for i, t, _ in rows])), labels


def test_learned_list_tells_held_out_junk(spark, make_docs, prose):
    rows, stats, labels = labelled(spark, make_docs, prose)
    learned = rules.learn_from(stats, labels, learnable=fold_of() != 1)
    assert learned
    out = {r["doc_id"]: r for r in rules.judge(stats, learned).withColumn("held", fold_of() == 1).collect()}
    held = [(i, q) for i, _, q in rows if out[i]["held"]]
    assert sum(out[i]["kept"] == bool(q) for i, q in held) / len(held) >= 0.97
    # the CASE expression is the list, read from the top
    table = {r["doc_id"]: r for r in stats.select("*", *[c.alias(n) for n, c in rules.steps().items()]).collect()}
    for i, r in out.items():
        first = next((k for k, rule in enumerate(learned, 1) if all((table[i][t.name] >= t.step) == t.at_least for t in rule)), 0)
        assert r["rule"] == first and r["kept"] == (first == 0 and not r["base_failed"])


def test_learning_does_not_depend_on_how_rows_are_dealt(spark, make_docs, prose):
    _, stats, labels = labelled(spark, make_docs, prose)
    assert rules.learn_from(stats, labels) == rules.learn_from(stats.repartition(5), labels.repartition(3))


def test_nothing_to_learn_from(spark, make_docs, prose):
    stats = rules.text_statistics(make_docs([(1, prose(60, 1)), (2, None), (None, prose(70, 2)), (1, prose(60, 1))]))
    for rows in ([], [(1, 1)], [(1, 0), (1, 1)], [(None, 0), (2, None)]):
        assert rules.learn_from(stats, spark.createDataFrame(rows, "doc_id long, quality int")) == []
    out = sorted((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in rules.judge(stats, []).collect())
    assert out == [(0, False, True), (1, False, True), (1, False, True), (2, True, False)]


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert rules.judge(rules.text_statistics(make_docs([])), []).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, [1], "z")], "doc_id long, text string, n_words int, words array<int>, kept string")
    row = rules.judge(rules.text_statistics(docs), []).first()
    assert row["n_words"] == 2 and row["kept"] is False


def test_long_words_and_many_kinds_of_junk_are_learned(spark, make_docs):
    rng = random.Random(7)

    def text(size, mark=""):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) + mark for _ in range(60 + rng.randrange(30)))

    # long words against longer ones, and one kind of junk for each of ten other marks or word lengths
    kinds = [(18, ""), (12, "#"), (12, "!"), (12, ","), (12, "7"), (12, "Q"), (2, ""), (30, ""), (50, ""), (80, ""), (120, "")]
    rows = [(i, text(12), 1) for i in range(300)]
    rows += [(1000 + i, text(*kinds[i % len(kinds)]), 0) for i in range(30 * len(kinds))]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    stats = rules.text_statistics(make_docs([(i, t) for i, t, _ in rows]))
    learned = rules.learn_from(stats, labels)
    out = {r["doc_id"]: r["kept"] for r in rules.judge(stats, learned).collect()}
    assert [i for i, _, q in rows if out[i] != bool(q)] == []


def test_refused_first_tests_give_way_to_others(spark):
    # the best first test of the growing rows tells nothing of the pruning rows; another one does
    names = list(rules.steps())
    rows = [(i % 2 == 0, i % 3 > 0, *[(5 if i % 2 == 0 else 0) if n == names[3] and i % 20 else (9 if i % 2 == 0 and i % 3 else 0) if n == names[0] else 1 for n in names]) for i in range(600)]
    marked = spark.createDataFrame(rows, "junk boolean, grow boolean, " + ", ".join(f"{n} int" for n in names))
    found = rules.learn(marked)
    assert found and any(t.name == names[3] for r in found for t in r)


def test_each_beginning_of_a_rule_is_counted_once_and_equal_rows_as_one(spark, monkeypatch):
    names = list(rules.steps())
    kinds = [(True, {names[0]: 9}), (True, {names[3]: 5}), (False, {}), (False, {names[5]: 4})]
    rows = [(junk, i % 3 > 0, *[marks.get(n, 1) for n in names]) for i in range(300) for junk, marks in kinds]
    marked = spark.createDataFrame(rows, "junk boolean, grow boolean, " + ", ".join(f"{n} int" for n in names))
    sizes, plain = [], rules._histogram

    def counted(rest):
        sizes.append(rest.count())
        return plain(rest)

    monkeypatch.setattr(rules, "_histogram", counted)
    found = rules.learn(marked)
    assert sorted(t.name for r in found for t in r) == sorted([names[0], names[3]])
    # all rows are measured once, before the first rule; rules find one kind of equal rows each
    assert sizes == [4, 1, 1]


def test_wide_first_tests_that_are_refused_are_counted_in_few_passes(spark, monkeypatch):
    # three junk rows amid the values of every statistic, none of them to prune on: a rule from every first test is refused
    rng = random.Random(3)
    names = list(rules.steps())
    rows = [(False, i % 3 > 0, *[rng.randrange(100) for _ in names]) for i in range(600)]
    rows += [(True, True, *[rng.randrange(20, 80) for _ in names]) for _ in range(3)]
    marked = spark.createDataFrame(rows, "junk boolean, grow boolean, " + ", ".join(f"{n} int" for n in names))
    exploded, plain = [], type(marked).groupBy

    def counted(self, *by):
        if by == ("c.name", "c.step"):
            exploded.append(self.count())
        return plain(self, *by)

    monkeypatch.setattr(type(marked), "groupBy", counted)
    assert rules.learn(marked) == []
    assert exploded[0] == 403 * len(names) and sum(exploded) <= 6 * exploded[0]


def test_subtracted_histograms_are_those_of_the_rows(spark):
    rng = random.Random(4)
    names = list(rules.steps())
    rows = [(rng.random() < 0.4, rng.randrange(1, 4), *[rng.randrange(9) for _ in names]) for _ in range(200)]
    table = spark.createDataFrame(rows, "junk boolean, times long, " + ", ".join(f"{n} int" for n in names))
    wide, narrow = rules.Test(names[0], True, 1), rules.Test(names[1], False, 2)
    seen = {(): rules._histogram(table)}
    for wanted in ([(wide,), (narrow,)], [(wide, narrow)], [(narrow, wide), (wide, narrow, rules.Test(names[2], True, 2))]):
        rules._measure(table, wanted, seen)
    for rule, found in seen.items():
        assert found == rules._histogram(table.filter(rules._all(rule))), rule
