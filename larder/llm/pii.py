"""Personal data in texts, plain and disguised, with the places in the source text.

Plain identifiers (e-mail, IP address, card and phone number) are found in the text as it is. For disguised ones a
chain of transducers writes a normalised text: lookalike characters and invisible ones, letters standing
for digits, spelled digits, and written-out or bracketed ``at`` and ``dot``. Each transducer is a list of edits,
(start, end, replacement) over its input, so a span of the last text maps back through the chain to source
characters: a copied character to itself, a replaced one to all it stands for. Identifiers of the normalised text
that do not lie in a plain one of their kind are added. A text without anything to edit has none to add.

Everything is found in whole texts in time linear in their length (patterns start at the head of a run of their
characters only). Offsets count code points, ends are exclusive. Texts are worked on where they lie; nothing is shuffled.

Rows: null text counts as empty and has no spans; texts of any length are scanned whole; overlapping
spans of different kinds all stay; repeated rows and null ids are rows like others; an empty table gives an empty
result; other columns are carried, and one named as the added column is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.shared import column

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"

Span = tuple[int, int]
Edit = tuple[int, int, str]

# Letters of other scripts that look like Latin ones, in the order of the alphabet.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЗавеѕіјкмнорстухԁԛԝһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧακινορυχ" + "·。",
        "ABESIJKMHOPCTYX3abesijkmhopctyxdqwh" + "ABEZHIKMNOPTYXakivopux" + "..",
        strict=True,
    )
)
# Digits as written in English, German, French and Spanish.
DIGIT_WORDS = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
}
AT_WORDS, DOT_WORDS = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto"

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9]*(?:\.[0-9]+)*")  # a pattern that begins with one set of characters passes over the rest of a text quickly
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


# --- plain identifiers ---


def _emails(text: str) -> list[Span]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", at + 1)
    return out


def _ips(text: str) -> list[Span]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or "0") <= 255

    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(small, four)):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


FINDERS = (_emails, _ips, _cards, _phones)


# --- transducers ---


class Rewritten:
    """A text after edits, with the way back from its offsets to those of the text before."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, at, now = [], 0, 0
        self._heads, self._from = [], []  # first offset of each piece here; (start, end or None for copies) there
        for start, end, new in edits:
            for piece, lo, hi in ((text[at:start], at, None), (new, start, end)):
                if piece:
                    self._heads.append(now)
                    self._from.append((lo, hi))
                    parts.append(piece)
                    now += len(piece)
            at = end
        if at < len(text):
            self._heads.append(now)
            self._from.append((at, None))
            parts.append(text[at:])
        self.text = "".join(parts)

    def back(self, span: Span) -> Span:
        first, last = (bisect_right(self._heads, i) - 1 for i in (span[0], span[1] - 1))
        start, replaced = self._from[first]
        if replaced is None:
            start += span[0] - self._heads[first]
        end, replaced = self._from[last]
        return start, replaced if replaced is not None else end + span[1] - self._heads[last]


@lru_cache(maxsize=1)
def _characters() -> tuple[dict[str, str], re.Pattern]:
    """ASCII counterparts of single characters, by Unicode's own tables, and a pattern of them all."""
    table = dict(LOOKALIKES)
    for code in (*range(0x80, 0x3400), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0xE0000, 0xE0080)):
        c = chr(code)
        kind, plain = unicodedata.category(c), unicodedata.normalize("NFKC", c)
        if kind == "Cf":
            table[c] = ""
        elif kind == "Nd":
            table[c] = str(unicodedata.decimal(c))
        elif kind == "Pd":
            table[c] = "-"
        elif len(plain) == 1 and " " <= plain <= "~":
            table[c] = plain
    return table, re.compile(f"[{''.join(map(re.escape, table))}]")


def plain_characters(text: str) -> list[Edit]:
    """Lookalikes become ASCII, invisible characters go."""
    if text.isascii():
        return []
    table, pattern = _characters()
    if table.keys().isdisjoint(set(text)):
        return []
    return [(m.start(), m.end(), table[m.group()]) for m in pattern.finditer(text)]


_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OoIl]*+(?![A-Za-z0-9]))[0-9OoIl]*[OoIl][0-9OoIl]*")


def digit_letters(text: str) -> list[Edit]:
    """O and l between digits of a word that consists of mostly digits."""
    beside = "".join(text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1] for m in _DOTTED.finditer(text))
    if not any(c in beside for c in "OoIl"):
        return []
    out = []
    for m in _MIXED.finditer(text):
        word = m.group()
        if 2 * sum("0" <= c <= "9" for c in word) >= len(word):
            out += [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for i, c in enumerate(word) if c in "OoIl"]
    return out


_TOKEN = re.compile(r"\w+")


@lru_cache(maxsize=2)
def words_of(text: str) -> frozenset[str]:
    """Distinct words in lower case; kept for the transducers that look at the same text."""
    return frozenset(_TOKEN.findall(text.lower()))


def _numbers_meet(text: str) -> bool:
    """Whether a number word stands next to another one, a number, ``plus`` or ``dot``."""
    words = _TOKEN.findall(text.lower())
    kinds = [2 if w in _SPELLED else w in _DOT_SET or w.isdigit() for w in words]
    return any(a and b and a + b > 2 for a, b in zip(kinds, kinds[1:]))


_AT_SET, _DOT_SET = frozenset(AT_WORDS.split("|")), frozenset(DOT_WORDS.split("|"))
_SPELLED = frozenset(DIGIT_WORDS) | {"plus"}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_WORD = re.compile(rf"(?<!\w)(?:(plus)|({_DIGIT})|(\d+)|({DOT_WORDS}))(?!\w)", re.IGNORECASE)
_GAP = re.compile(r"[ \t]{0,3}[,-]?[ \t]{0,3}")
_DOT_GAP = re.compile(r"[ \t]{0,3}[\[({<]?[ \t]{0,3}")
_AFTER_DOT = re.compile(r"[ \t]{0,3}[\])}>]?[ \t]{0,3}")


def spelled_digits(text: str) -> list[Edit]:
    """Digits written as words, where two or more number words, or a number word and ``plus`` or ``dot``, follow each other."""
    if _SPELLED.isdisjoint(words_of(text)) or not _numbers_meet(text):
        return []
    out: list[Edit] = []
    run: list[tuple[int, int, str, bool]] = []  # start, end, written as, was a word

    def close() -> None:
        while run and run[-1][2] == ".":
            run.pop()
        if sum(word for *_, word in run) >= 2 and any(new.isdigit() and word for *_, new, word in run):
            for i, (start, end, new, word) in enumerate(run):
                if i and (word or run[i - 1][3]) and run[i - 1][1] < start:
                    out.append((run[i - 1][1], start, ""))
                if word:
                    out.append((start, end, new))
        run.clear()

    for m in _WORD.finditer(text):
        plus, digit, number, _ = m.groups()
        gap = _DOT_GAP if not (plus or digit or number) else _AFTER_DOT if run and run[-1][2] == "." else _GAP
        if run and (plus or not gap.fullmatch(text, run[-1][1], m.start())):
            close()
        if digit:
            run.append((*m.span(), DIGIT_WORDS[digit.lower()], True))
        elif number:
            run.append((*m.span(), number, False))
        elif plus:
            run.append((*m.span(), "+", True))
        elif run:
            run.append((*m.span(), ".", True))
    close()
    return out


_BRACKETED = re.compile(rf"[\[({{<][ \t]{{0,3}}(?:({AT_WORDS}|@|ät)|{DOT_WORDS}|\.)[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}", re.IGNORECASE)


def bracketed_signs(text: str) -> list[Edit]:
    """``[at]``, ``(dot)`` and the like between letters or digits."""
    out, done = [], 0
    for m in _BRACKETED.finditer(text):
        start, end = m.span()
        while start > max(done, m.start() - 3) and text[start - 1] in " \t":
            start -= 1
        if start > done and end < len(text) and text[start - 1].isalnum() and text[end].isalnum():
            out.append((start, end, "@" if m.group(1) else "."))
        done = end
    return out


_AT = re.compile(rf"@|[ \t]{{1,3}}(?:{AT_WORDS})[ \t]{{1,3}}", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(rf"\.|[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]{{1,3}}", re.IGNORECASE)
_DOT_BEFORE = re.compile(rf"[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]{{1,3}}\Z", re.IGNORECASE)


def spoken_signs(text: str) -> list[Edit]:
    """``name at host dot com``: bare words, where the whole address stands around them.

    A bare ``at`` before plain dots counts only after a name with a digit, dot or underscore.
    """
    words = words_of(text)
    if _AT_SET.isdisjoint(words) and ("@" not in text or _DOT_SET.isdisjoint(words)):
        return []
    out: list[Edit] = []
    done = 0
    for m in _AT.finditer(text):
        start, at = m.span()
        if start < done or not start or text[start - 1] not in LOCAL:
            continue
        edits, spoken, plain = [], 0, 0
        label = _LABEL.match(text, at)
        while label:
            dot = _DOT.match(text, label.end())
            after = dot and _LABEL.match(text, dot.end())
            if not after:
                break
            if dot.group() == ".":
                plain += 1
            else:
                spoken += 1
                edits.append((*dot.span(), "."))
            label = after
        if not label or not (plain or spoken) or (spoken and not re.search(r"[A-Za-z]{2}\Z", label.group())):
            continue
        before, name, free = [], start, done
        while name > free and text[name - 1] in LOCAL:
            name -= 1
        marked = any(c in "._" or c.isdigit() for c in text[name:start])
        while (dot := _DOT_BEFORE.search(text, max(free, name - 16), name)) and dot.start() > free and text[dot.start() - 1] in LOCAL:
            before.append((*dot.span(), "."))
            name = dot.start()
            while name > free and text[name - 1] in LOCAL:
                name -= 1
        if m.group() == "@":
            if not (spoken or before):
                continue
        elif not (spoken or before or marked):
            continue
        out += [*reversed(before), *([] if m.group() == "@" else [(start, at, "@")]), *edits]
        done = label.end()
    return out


TRANSDUCERS = (plain_characters, digit_letters, bracketed_signs, spelled_digits, spoken_signs)


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, found in the plain text) by kind and place."""
    text = text or ""
    base = [finder(text) for finder in FINDERS]
    chain, now = [], text
    for transducer in TRANSDUCERS:
        if edits := transducer(now):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    out = []
    for kind, finder, plain in zip(KINDS, FINDERS, base, strict=True):
        spans = {(*s, True) for s in plain}
        for span in finder(now) if chain else ():
            for step in reversed(chain):
                span = step.back(span)
            # the nearest plain span that starts no later is the only one that can hold it
            i = bisect_right(plain, (span[0], len(text))) - 1
            if i < 0 or plain[i][1] < span[1]:
                spans.add((*span, False))
        out += [(kind, *s) for s in sorted(spans)]
    return out


def _found(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find_spans(t)] for t in texts], dtype=object)


def with_spans(docs: DataFrame, text_col: str = "text", spans_name: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, base) per row, by kind and place."""
    return docs.withColumn(spans_name, F.pandas_udf(_found, SPANS)(column(text_col).cast("string")))


def _masked(texts: pd.Series) -> pd.Series:
    def mask(text: str) -> str:
        parts, at = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e, _ in find_spans(text)):
            if start >= at:
                parts += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    return pd.Series([None if t is None else mask(t) for t in texts], dtype=object)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced as one by the first."""
    return docs.withColumn(text_col, F.pandas_udf(_masked, "string")(column(text_col).cast("string")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
