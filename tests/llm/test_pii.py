import random
import re

import pytest
from pyspark.sql import functions as F

from larder.llm import pii

# the contract's patterns, as written
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def digits(m):
        return re.sub(r"[^0-9]", "", m.group())

    def checks(d):
        twice = [int(c) * 2 for c in d[-2::-2]]
        return (sum(int(c) for c in d[-1::-2]) + sum(x // 10 + x % 10 for x in twice)) % 10 == 0

    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and checks(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def base_of(text):
    return [s[:3] for s in pii.find_spans(text) if s[3]]


@pytest.mark.parametrize("seed", range(6))
def test_plain_spans_match_the_patterns(seed):
    rng = random.Random(seed)
    for alphabet in ("0123456789.", "0123456789 -", "+0123456789 .()-", "ab1@.-", "a1@.+- (%_", "é0１.@a ​"):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert base_of(text) == plain(text), text
    for _ in range(300):
        text = " ".join(rng.choice(("4111 1111 1111 1111", "10.0.0.256", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (234) 555-0199", "x", "4111-1111", "٣")) for _ in range(8))
        assert base_of(text) == plain(text), text


DISGUISED = [
    ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("write to john(at)example.com now", "email", "john(at)example.com"),
    ("write john at example dot co dot uk, please", "email", "john at example dot co dot uk"),
    ("mail jane dot roe at mail7 dot example dot com.", "email", "jane dot roe at mail7 dot example dot com"),
    ("mail jane_roe at example.com.", "email", "jane_roe at example.com"),
    ("mail jane@example dot com", "email", "jane@example dot com"),
    ("hier: max arroba beispiel punto com", "email", "max arroba beispiel punto com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ ok", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
    ("to jo​hn@exam​ple.com ok", "email", "jo​hn@exam​ple.com"),
    ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
    ("host 192 dot 168 dot zero dot one up", "ip", "192 dot 168 dot zero dot one"),
    ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
    ("host １９２.168.0.1 up", "ip", "１９２.168.0.1"),
    ("card 4111 1111 1111 1111 ok", "card", "4111 1111 1111 1111"),
    ("card four one one one 1111 1111 one one one one ok", "card", "four one one one 1111 1111 one one one one"),
    ("card 4lll llll 1111 1111 ok", None, None),
    ("card 41l1 1111 1111 1111 ok", "card", "41l1 1111 1111 1111"),
    ("call +٤٩ 170 5550199 now", "phone", "+٤٩ 170 5550199"),
    ("call plus one two one two five five five zero one nine nine now", "phone", "plus one two one two five five five zero one nine nine"),
    ("call +1 two one two 555 0199", "phone", "+1 two one two 555 0199"),
]


@pytest.mark.parametrize(("text", "kind", "hidden"), DISGUISED)
def test_disguised_spans_map_back(text, kind, hidden):
    added = [(k, text[s:e]) for k, s, e, base in pii.find_spans(text) if not base]
    assert added == ([(kind, hidden)] if kind else [])


@pytest.mark.parametrize(
    "text",
    [
        "We met at noon and one of the two dots was at the top. Look at this.",
        "Un deux trois, il est six heures; le point est ici.",
        "See me at example.com or at home, version 1.2.3, pages 10-12.",
        "In 2020 one 4 two 5 were sold at 3.99 each; x[at]y and (.) too.",
        "Росія і Україна: текст без адрес. Καλημέρα κόσμε.",
        "O2 and H2O, 10l of oil, I am 1 of 100.",
        "",
    ],
)
def test_clean_texts_stay_clean(text):
    assert pii.find_spans(text) == []


def test_offsets_survive_all_transducers():
    rng = random.Random(3)
    pool = list("ab12 .@+-") + ["１", "о", "​", " dot ", " at ", "one ", "two ", "[at]", "(dot)", "plus "]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        now, chain = text, []
        for t in pii.TRANSDUCERS:
            edits = t(now)
            assert all(a[1] <= b[0] for a, b in zip(edits, edits[1:])), (text, edits)
            if edits:
                chain.append(pii.Rewritten(now, edits))
                now = chain[-1].text
        for i in range(len(now)):
            span = (i, i + 1)
            for step in reversed(chain):
                span = step.back(span)
            assert 0 <= span[0] < span[1] <= len(text)
            assert now[i] == text[span[0]] or (span[1] - span[0] >= 1)
        assert [s[:3] for s in pii.find_spans(text) if s[3]] == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000, "dot " * 50_000, "one " * 60_000, "a at " * 50_000, "[" * 100_000, "a dot " * 40_000 + "@b.c", " " * 200_000, "l0" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    start = time.perf_counter()
    pii.find_spans(text)
    assert time.perf_counter() - start < 5


def test_rows_nulls_clashes_and_masks(spark):
    rows = [(1, "a@b.org", "x"), (None, None, None), (2, "", "y"), (1, "a@b.org", "x"), (3, "z " * 100_000 + "c [at] d.org", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.with_spans(docs).select("doc_id", pii.written(F.col("spans")).alias("w")).collect()
    assert sorted((r["doc_id"] or 0, r["w"]) for r in out) == [(0, ""), (1, "email:0:7"), (1, "email:0:7"), (2, ""), (3, "email:200000:200012")]
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    assert sorted(r["text"][-10:] for r in masked.where("doc_id <> 2").collect()) == [" z [email]", "[email]", "[email]"]
    assert pii.with_spans(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []
