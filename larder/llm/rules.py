"""Quality rules: decision lists learned by sequential covering over text statistics.

Statistics come from built-in array and string functions, one narrow row per document. A rule is a
conjunction of thresholds that marks junk. It is grown on two thirds of the labelled documents, one
threshold at a time by information gain, and pruned on the rest, back to the prefix that tells junk
best; documents it covers are set aside and the next rule is grown. All counting is done by grouped sums
over all labelled documents, and only counts per (statistic, step) come to the driver. The list is
emitted as one ordered ``CASE`` expression.

Thresholds lie on fixed steps (hundredths of a share, 64ths of a power of two above ten, eighths of one for lengths), so counts and rules do not
depend on how rows were dealt.

A list may have any number of rules and a rule any number of tests: covering ends when no junk is left that some rule tells
well enough.

Rows: null and empty texts have zero statistics and fail the base rules; documents labelled both ways and
null labels are not learned from; without labels of both kinds the list is empty; repeated rows are judged
one by one; texts of any length are counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import column, stage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the base rules, and further counts for learning."""
    text = F.col("text")

    def count_of(chars: str) -> Column:
        return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    split = rows.select(
        "doc_id",
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count_of("0123456789").alias("n_digits"),
        count_of("!?").alias("n_marks"),
        count_of(".,").alias("n_stops"),
    )
    counted = split.select(
        "doc_id",
        *[c for c in split.columns if c.startswith("n_") or c == "word_chars"],
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.when(
            F.size("words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("grams"),
    )
    # only texts with a repeated window are sorted
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    ordered = counted.select(
        *[c for c in counted.columns if c != "grams"],
        F.when(repeated, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("ordered"),
    )
    last = F.size("ordered") - 1
    # neighbours in hash order that are equal are repeats; get() gives null beyond either end
    places = F.transform(
        F.filter(
            F.sequence(F.lit(0), last),
            lambda k: F.coalesce(F.get("ordered", k)["g"] == F.get("ordered", k - 1)["g"], F.lit(False))
            | F.coalesce(F.get("ordered", k)["g"] == F.get("ordered", k + 1)["g"], F.lit(False)),
        ),
        lambda k: F.get("ordered", k)["i"],
    )
    placed = ordered.select(
        *[c for c in ordered.columns if c != "ordered"], F.when(F.col("ordered").isNotNull(), F.sort_array(places)).alias("places")
    )
    # words covered by windows of three that start at the sorted places
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n")),
        lambda acc: acc["n"],
    )
    return placed.select(
        *[c for c in placed.columns if c != "places"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def base_failed() -> Column:
    """Too short, or more than half of the words repeat."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


LINEAR = 1000  # hundredths up to here are steps of their own


def _share(part: str, whole: str) -> Column:
    """Whole hundredths, rounded down, up to ``LINEAR``; beyond it steps of about 1 %, so their number stays small; 0 where there is nothing."""
    hundredths = 100 * F.col(part) / F.col(whole)
    wide = F.lit(LINEAR) + F.floor(64 * F.log2(hundredths / LINEAR))
    return F.when(F.col(whole) > 0, F.when(hundredths < LINEAR, F.floor(hundredths)).otherwise(wide)).otherwise(0).cast("int")


def _size(of: str) -> Column:
    """Eighths of a power of two, rounded down."""
    return F.floor(8 * F.log2(F.col(of) + 1)).cast("int")


def steps() -> dict[str, Column]:
    """Steps of each statistic that rules may test."""
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "capital_share": _share("n_capitals", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "mark_share": _share("n_marks", "n_words"),
        "stop_share": _share("n_stops", "n_words"),
        "symbol_rate": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "distinct_share": _share("n_distinct", "n_words"),
        "word_size": _share("word_chars", "n_words"),
        "length": _size("n_words"),
    }


@dataclass(frozen=True)
class Test:
    """``name`` at least ``step`` (or below it)."""

    name: str
    at_least: bool
    step: int

    def condition(self) -> Column:
        c = F.col(self.name)
        return c >= self.step if self.at_least else c < self.step

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.step}"


Rule = tuple[Test, ...]
Histogram = dict[str, dict[int, tuple[int, int]]]  # (junk documents, other documents, rows) per step of each statistic


@dataclass(frozen=True)
class Covering:
    min_precision: float = 0.9
    min_covered: int = 2


DEFAULT = Covering()


def _all(tests: Rule) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.condition()
    return out


def learn(marked: DataFrame, plan: Covering = DEFAULT) -> list[Rule]:
    """Ordered junk rules from a table of steps with ``junk`` (boolean) and ``grow`` (boolean).

    Ends when no junk is left to cover, or when a rule has been tried from every statistic and none stood pruning.
    Rows that are equal in all steps are counted once and for all. Histograms are measured once for each beginning of a rule;
    that of the rows left after a rule is the one before, less that of the rule. If the rule from the best first test is
    refused, those from all other first tests are grown side by side, in one pass for each length.
    """
    rules: list[Rule] = []
    rest = stage(marked.groupBy(*steps(), "junk", "grow").agg(F.count("*").alias("times")), "rules-labelled")
    seen: dict[Rule, Histogram] = {(): _histogram(rest.filter("grow"))}
    while True:
        starts = _starts(seen[()], plan)
        grown = (r for some in (starts[:1], starts[1:]) for r in _grown(rest.filter("grow"), plan, some, seen))
        rule = next((kept for r in grown if (kept := _pruned(r, rest.filter("not grow"), plan))), ())
        if not rule:
            return rules
        rules.append(rule)
        seen = {(): _without(seen[()], seen[rule])}
        rest = rest.filter(~_all(rule))


def _histogram(rows: DataFrame) -> Histogram:
    """Junk and other documents and rows per step of each statistic."""
    return _histograms(rows, [F.lit(True)])[0]


def _histograms(rows: DataFrame, sides: list[Column]) -> list[Histogram]:
    """Histograms of the rows under each condition, in one pass over the rows that are under any."""
    names, marks = list(steps()), [f"in{i}" for i in range(len(sides))]
    dealt = rows.select("junk", "times", *names, *[s.alias(m) for s, m in zip(sides, marks, strict=True)]).filter(" or ".join(marks))
    cells = dealt.select("junk", "times", *marks, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("step")) for n in names])).alias("c"))
    sums = [F.array(_times(F.col(m) & F.col("junk")), _times(F.col(m) & ~F.col("junk")), F.count_if(m)).alias(m) for m in marks]
    out: list[Histogram] = [{n: {} for n in names} for _ in sides]
    for row in cells.groupBy("c.name", "c.step").agg(*sums).collect():  # steps are bounded: a few thousand per statistic
        for histogram, m in zip(out, marks, strict=True):
            if row[m][2]:
                histogram[row["name"]][row["step"]] = tuple(row[m])
    return out


def _measure(rows: DataFrame, rules: list[Rule], seen: dict[Rule, Histogram]) -> None:
    """Adds the histograms of rules that are one test longer than those in ``seen``, over the same rows.

    Of the rows under the tests before the last, those that it covers or those that it leaves out are counted, whichever
    are fewer; the others follow by subtraction. So a rule of any length costs about as many rows as there are.
    """
    fewer, sides = [], []
    for rule in rules:
        last, cells = rule[-1], seen[rule[:-1]][rule[-1].name]
        covered = sum(c[2] for step, c in cells.items() if (step >= last.step) == last.at_least)
        fewer.append(2 * covered <= sum(c[2] for c in cells.values()))
        sides.append(_all(rule) if fewer[-1] else _all(rule[:-1]) & ~last.condition())
    found = [_histogram(rows.filter(sides[0]))] if len(sides) == 1 else _histograms(rows, sides)
    for rule, is_rule, part in zip(rules, fewer, found, strict=True):
        seen[rule] = part if is_rule else _without(seen[rule[:-1]], part)


def _times(condition: Column) -> Column:
    """Rows of the labelled documents under a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("times"))), F.lit(0))


def _without(whole: Histogram, part: Histogram) -> Histogram:
    """Counts of the rows of ``whole`` that are not in ``part``; steps without rows are left out."""
    out: Histogram = {}
    for name, cells in whole.items():
        left = {step: tuple(x - y for x, y in zip(counts, part[name].get(step, (0, 0, 0)), strict=True)) for step, counts in cells.items()}
        out[name] = {step: counts for step, counts in left.items() if any(counts)}
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _best(seen: Histogram, plan: Covering, refused: frozenset[tuple[str, bool]] = frozenset()) -> Test | None:
    """The test of largest information gain, if there is junk and more; not of the statistics and directions in ``refused``."""
    best: tuple[float, Test | None] = (1e-9, None)
    clean = True
    for name, cells in seen.items():
        p0, n0 = (sum(c[i] for c in cells.values()) for i in (0, 1))
        if not p0:
            return None
        clean = clean and not n0
        p, n = 0, 0
        for step in sorted(cells):  # rows below each step, rows from it on
            for at_least, covered in ((True, (p0 - p, n0 - n)), (False, (p, n))):
                gain = _gain(*covered, p0, n0)
                if (name, at_least) in refused:
                    continue
                if covered[0] >= plan.min_covered and gain > best[0] + 1e-9:
                    best = (gain, Test(name, at_least, step))
            p, n = p + cells[step][0], n + cells[step][1]
    return None if clean else best[1]


def _starts(seen: Histogram, plan: Covering) -> list[Test]:
    """The best first test, and the best of the statistics and directions that are left after each."""
    found: list[Test] = []
    while test := _best(seen, plan, frozenset((t.name, t.at_least) for t in found)):
        found.append(test)
    return found


def _grown(rows: DataFrame, plan: Covering, starts: list[Test], seen: dict[Rule, Histogram]) -> list[Rule]:
    """A rule from each first test: tests added by largest information gain until only junk is covered.

    ``seen`` holds the histogram of the rows; those of all beginnings of the rules are added.
    """
    rules: dict[Test, Rule] = {t: (t,) for t in starts}
    growing = starts
    while growing:
        _measure(rows, [rules[t] for t in growing], seen)
        added = {t: test for t in growing if (test := _best(seen[rules[t]], plan))}
        rules |= {t: (*rules[t], test) for t, test in added.items()}
        growing = list(added)
    return list(rules.values())


def _pruned(rule: Rule, rows: DataFrame, plan: Covering) -> Rule:
    """The prefix of the rule that tells junk best on unseen rows, or nothing if none does well enough."""
    if not rule:
        return ()
    prefixes = [rule[: i + 1] for i in range(len(rule))]
    sums = [_times(_all(x) & is_).alias(f"{k}{i}") for i, x in enumerate(prefixes) for k, is_ in (("p", F.col("junk")), ("n", ~F.col("junk")))]
    row = rows.agg(*sums).first()
    best: tuple[float, Rule] = (-1.0, ())
    for i, x in enumerate(prefixes):
        p, n = row[f"p{i}"], row[f"n{i}"]
        if p >= plan.min_covered and p / (p + n) >= plan.min_precision and (p - n) / (p + n) * p > best[0]:
            best = ((p - n) / (p + n) * p, x)
    return best[1]


def learn_from(statistics: DataFrame, labels: DataFrame, learnable: Column | None = None, plan: Covering = DEFAULT) -> list[Rule]:
    """Rules from statistics (doc_id, counts) and labels (doc_id, quality 0 or 1)."""
    marked = labels.select(column("doc_id").cast("long").alias("doc_id"), column("quality").alias("quality"))
    marked = marked.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if learnable is not None:
        marked = marked.filter(learnable)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).filter("quality = top")
    fold = F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string"))), F.lit(3))
    table = (
        statistics.filter(~base_failed())
        .join(marked, "doc_id")
        .select((F.col("quality") == 0).alias("junk"), (fold != 0).alias("grow"), *[c.alias(n) for n, c in steps().items()])
    )
    return learn(table, plan)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that marks a row as junk, 0 for none; over columns named as the steps."""
    case = None
    for i, rule in enumerate(rules, 1):
        case = F.when(_all(rule), i) if case is None else case.when(_all(rule), i)
    return F.lit(0) if case is None else case.otherwise(0)


def judge(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with base_failed, rule (number of the first junk rule, 0 for none) and kept."""
    tested = statistics.select("*", *[c.alias(n) for n, c in steps().items()])
    out = tested.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop(*steps())
