"""Plain Python versions of the contracts, for comparison."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def components(rows):
    """{doc_id: (n, component)} of (doc_id, text)."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if linked(sets[a], sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(s), find(d)) for d, s in sets.items()}


def cut_repeats(rows, window=20):
    """{doc_id: (n_words, n_removed, kept)} of (doc_id, text)."""
    first = {}
    texts = {d: words(t) for d, t in rows}
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(threes)
    covered = {j for i, t in enumerate(threes) if count[t] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
