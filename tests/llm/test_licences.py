import random

import numpy as np

from larder.llm import licences
from larder.llm.benchmark import plain_words

from .conftest import edit


def test_notices_are_found_and_prose_is_not(spark, make_docs, prose):
    rows, want = [], set()
    for k, (family, notices) in enumerate(sorted(licences.TEMPLATES.items())):
        for j, notice in enumerate(notices):
            doc = 100 * k + j
            rows.append((doc, f"{prose(40, doc)}\n{notice.upper() if j else notice}\n{prose(20, doc + 50)}"))
            want.add((doc, 1, family))
    rows += [(10_000 + i, f"{prose(60, i)}\nThe licence plate of the car was under the seat.\nall of the rights of the author") for i in range(30)]
    out = licences.scan(make_docs(rows)).collect()
    got = {(r["doc_id"], r["line"], r["family"]) for r in out}
    assert {x for x in got if x[0] >= 10_000} == set()
    assert len(want & got) / len(want) >= 0.9 and len(got - want) <= 2
    assert all(licences.DEFAULT.least <= r["probability"] <= 1 and r["agreement"] >= licences.DEFAULT.agree for r in out)


def test_held_out_edits_keep_their_family(prose):
    scanner = licences.fit([prose(12, i) for i in range(200)])
    rng = random.Random(9)
    right = total = 0
    for family, notices in licences.TEMPLATES.items():
        for notice in (n for n in notices if len(n.split()) > 10):
            for _ in range(5):
                found = licences.classify(scanner, plain_words(edit(notice, 1, rng.randrange(10**6))))
                right += found is not None and found[0] == family
                total += 1
    assert right / total >= 0.85


def test_line_filter_passes_every_line_with_three_template_pairs(prose):
    scanner = licences.fit([prose(12, i) for i in range(20)])
    quick = np.zeros(1 << 20, bool)
    quick[(scanner.pairs >> np.uint64(44)).astype(np.int64)] = True
    lines = [prose(9, 1), "", "Released under the MIT License.", "\x01", "licensed under the x", "Licensed under the BSD License"]
    found = {i: w.tolist() for i, w in licences._lines_near("\n".join(lines), scanner.pairs, quick)}
    pairs = set(scanner.pairs.tolist())
    want = {i: plain_words(x).tolist() for i, x in enumerate(lines) if sum(g in pairs for g in licences.grams(plain_words(x), 2).tolist()) >= 3}
    assert found == want and 2 in found


def test_nulls_repeats_and_clashing(spark, make_docs):
    notice = "Released under the MIT License."
    out = licences.scan(make_docs([(1, notice), (1, notice), (None, notice), (2, None), (3, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["line"], r["family"]) for r in out) == [(0, 0, "mit"), (1, 0, "mit"), (1, 0, "mit")]
    assert licences.scan(make_docs([])).count() == 0
    docs = spark.createDataFrame([(1, "x\n" * 100_000 + notice, "f", 2)], "doc_id long, text string, family string, line int")
    assert [(r["line"], r["family"]) for r in licences.scan(docs).collect()] == [(100_000, "mit")]


def test_lines_of_two_and_three_words_are_found(spark, make_docs, prose):
    short = {"All rights reserved.": "proprietary", "MIT License": "mit", "# The MIT License": "mit", "// SPDX-License-Identifier: MIT": "mit"}
    short |= {"Apache License": "apache", "BSD License": "bsd", "GNU GPL": "gpl", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl", "License: CC0": "cc0"}
    others = ["All rights", "rights reserved", "All rights reserved seats", "Drivers License", "SPDX-License-Identifier: Zlib", "License", "MIT", "apache", "", "CC"]
    rows = [(i, f"{prose(30, i)}\n\n{line}\n{prose(9, 90 + i)}") for i, line in enumerate([*short, *others])]
    rows += [(100 + i, line) for i, line in enumerate([*short, *others])]
    out = {(r["doc_id"], r["line"], r["family"]) for r in licences.scan(make_docs(rows)).collect()}
    assert out == {(i, 2, f) for i, f in enumerate(short.values())} | {(100 + i, 0, f) for i, f in enumerate(short.values())}


def test_every_short_notice_has_one_family_and_is_found():
    scanner = licences.fit([])
    quick = np.zeros(1 << 20, bool)
    notices = [(n, f) for f, ns in licences.SHORT.items() for n in ns]
    found = {i: licences.classify(scanner, w) for i, w in licences._lines_near("\n".join(n for n, _ in notices), scanner.pairs, quick, scanner.heads)}
    assert {i: f for i, (_, f) in enumerate(notices)} == {i: x and x[0] for i, x in found.items()}


def test_notices_of_other_licences_are_unknown(prose):
    scanner = licences.fit([prose(12, i) for i in range(200)])
    others = [
        "Licensed under the Eclipse Public License 2.0.",
        "Licensed under the Python Software Foundation License, version 2.",
        "Licensed under the Foo License, Version 1.1.",
        "This work is licensed under the Sunshine Public License, version 3.",
        "Released under the Zope Public License.",
    ]
    assert [x for x in others if licences.classify(scanner, plain_words(x))] == []
    known = {"Licensed under the Apache License 2.0.": "apache", "Released under the MIT License.": "mit", "Licensed under the Mozilla Public License, version 2.": "mpl"}
    assert {x: (licences.classify(scanner, plain_words(x)) or [None])[0] for x in known} == known


def test_wrapped_notices_are_found(spark, make_docs, prose):
    import textwrap

    rows, want = [], set()
    long = {"mit": licences.TEMPLATES["mit"][0], "apache": licences.TEMPLATES["apache"][0], "gpl": licences.TEMPLATES["gpl"][0], "bsd": licences.TEMPLATES["bsd"][0]}
    for k, (family, notice) in enumerate(long.items()):
        rows.append((k, f"{prose(40, k)}\n\n" + "\n".join(textwrap.wrap(notice, 40)) + f"\n\n{prose(20, k + 9)}"))
        want.add((k, family))
    out = licences.scan(make_docs(rows)).collect()
    assert {(r["doc_id"], r["family"]) for r in out} == want and len(out) <= 2 * len(want)


def test_verdicts_match_a_plain_scan(spark, make_docs, prose):
    """Every line and every run of neighbouring lines, tried one by one."""
    lines = [t for ts in licences.TEMPLATES.values() for t in ts] + ["All rights reserved.", "MIT License", "", "the licence of the car"]
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice([prose(8, 10 * i + k), rng.choice(lines), " ".join(rng.choice(lines).split()[:5])]) for k in range(12))) for i in range(40)]
    docs = make_docs(rows)
    got = {(r["doc_id"], r["line"], r["family"]) for r in licences.scan(docs).collect()}
    sample = sorted({x[: licences.SAMPLE_CHARS] for _, t in rows for x in [y for y in t.split("\n") if len(y) > 20][:2]})
    scanner = licences.fit(sample)
    pairs, want = set(scanner.pairs.tolist()), set()
    for doc, text in rows:
        words = [plain_words(x) for x in text.split("\n")]
        near = [sum(g in pairs for g in licences.grams(w, 2).tolist()) if len(w) > 1 else 0 for w in words]
        single = {i: f[0] for i, w in enumerate(words) if (near[i] >= 3 or w.tobytes() in scanner.short) and (f := licences.classify(scanner, w))}
        want |= {(doc, i, f) for i, f in single.items()}
        at = 0
        while at < len(words):
            end = at
            while end < len(words) and near[end]:
                end += 1
            if end - at > 1 and not any(i in single for i in range(at, end)) and (f := licences.classify(scanner, np.concatenate(words[at:end]))):
                want.add((doc, at, f[0]))
            at = max(end, at + 1)
    assert want and got == want
