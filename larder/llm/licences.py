"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line with words, or a run of neighbouring lines that all hold template bigrams, as a notice wrapped by hand
has; a run is tried as a whole where none of its lines is a finding. Features are its word unigrams and bigrams that occur in any template
(lower-cased letters and digits). A softmax regression over licence families and an ``unknown`` class is
trained in numpy on edited copies of the templates against lines of the corpus, shuffled template words, and notices of
other licences: the templates with their family's names replaced by other words, so that the frame of a notice
without a known name is no evidence. Its temperature is fitted on edits it has not seen, and a family is named from ``least``
probability on. A finding must also share ``agree`` of its bigrams with a template of that family, three
at least. That condition lets a scan pass over lines with fewer template bigrams.

A line that is as a whole one of the short notices (headings, tags, 'All rights reserved.') is a finding with
probability and agreement 1; two words are enough. Such lines are looked up, not classified, as they have too few
bigrams to be told from prose by a share of them.

The corpus gives about ``SAMPLE_ROWS`` documents, chosen by a threshold on a hash, as examples of other lines, of which two
lines of ``SAMPLE_CHARS`` characters each reach the driver; every line of every document is scanned. The scan is map-only.

Rows: null and empty texts have no lines and no findings; texts of any length are scanned whole; repeated rows give
their own findings; of equal probabilities the first family by name counts; null ids are carried; an empty table
gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.benchmark import plain_words
from larder.llm.shared import batches, column
from larder.llm.wordhash import byte_values, grams, word_hashes

SAMPLE_ROWS, SAMPLE_CHARS = 400, 400
BREAK = "\x01"  # stands for a line break among the words
LINED = byte_values(spaces=bytes(b for b in range(128) if not chr(b).isalnum() and chr(b) != BREAK))
BREAK_HASH = word_hashes(BREAK.encode(), LINED)[0]
UNKNOWN = "unknown"

# Short public notices of common licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU AGPL, version 3.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Available under the Creative Commons Attribution License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Released under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This work is dedicated to the public domain under CC0 1.0.",
    ),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL, version 2 or later.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form without prior written permission.",
        "Copyright reserved by the owner. Unauthorized copying or distribution of this file is strictly prohibited.",
    ),
}

# Names and SPDX identifiers of licences, by family; a heading or tag is made of one of them.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache", "Apache Software License", "Apache 2.0", "Apache-2.0"),
    "bsd": ("BSD", "BSD 2-Clause", "BSD 3-Clause", "BSD-2-Clause", "BSD-3-Clause", "0BSD"),
    "cc-by": ("Creative Commons Attribution", "Creative Commons Attribution 4.0 International", "CC BY", "CC BY 3.0", "CC BY 4.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC", "CC BY-NC 3.0", "CC BY-NC 4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA", "CC BY-SA 3.0", "CC BY-SA 4.0"),
    "cc0": ("CC0", "CC0 1.0", "CC0 1.0 Universal"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "MPL", "MPL 2.0", "MPL-2.0"),
}
FORMS = ("{}", "{} License", "The {} License", "License: {}", "Licensed under {}", "Licensed under the {} License", "SPDX-License-Identifier: {}")

# Words of names that stand in notices of any licence.
FRAME = "general public license software source international creative commons version 0 1 2 3 4 only or later clause"

# Whole lines that are findings by themselves; forms of fewer than two words are left out.
SHORT: dict[str, tuple[str, ...]] = {f: tuple(x for n in names for form in FORMS if len(plain_words(x := form.format(n))) > 1) for f, names in NAMES.items()}
SHORT["mit"] += ("MIT License (MIT)", "The MIT License (MIT)")
SHORT["proprietary"] = ("All rights reserved.", "© All rights reserved.", "Copyright. All rights reserved.", "Copyright (c). All rights reserved.")


@dataclass(frozen=True)
class Plan:
    edits: int = 40  # edited copies of each template
    steps: int = 300
    least: float = 0.7
    agree: float = 0.5
    seed: int = 5


DEFAULT = Plan()


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words, grams(words, 2)


@dataclass
class Scanner:
    families: list[str]  # the last one is unknown
    vocabulary: np.ndarray  # sorted hashes of unigrams and bigrams
    weights: np.ndarray  # a row for each n-gram, and one for the bias
    temperature: float
    pairs: np.ndarray  # sorted hashes of template bigrams
    templates: dict[str, list[set[int]]]  # bigrams of each template
    short: dict[bytes, str]  # family of the words of each short notice
    heads: np.ndarray  # sorted hashes of the first bigrams of short notices

    def features(self, words: np.ndarray) -> np.ndarray:
        seen = np.unique(np.concatenate(_grams(words)))
        at = np.minimum(np.searchsorted(self.vocabulary, seen), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == seen]

    def probabilities(self, words: np.ndarray) -> np.ndarray:
        at = self.features(words)
        raw = self.weights[at].sum(axis=0) / np.sqrt(max(len(at), 1)) + self.weights[-1]
        return _softmax(raw[None, :] / self.temperature)[0]

    def agreement(self, family: str, words: np.ndarray) -> float:
        """Largest share of bigrams, of the shorter of line and template, that both have."""
        own = set(_grams(words)[1].tolist())
        best = 0.0
        for template in self.templates[family]:
            common = len(own & template)
            if common >= 3:
                best = max(best, common / min(len(own), len(template)))
        return best


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _edit(words: np.ndarray, rng: random.Random, filler: list[np.ndarray]) -> np.ndarray:
    """A template with some words lost or replaced, and text before or after it."""
    out: list[int] = []
    for w in words.tolist():
        r = rng.random()
        if r < 0.05:
            continue
        if r < 0.10 and filler:
            other = rng.choice(filler)
            w = int(other[rng.randrange(len(other))])
        out.append(w)
    if filler and rng.random() < 0.4:
        other = rng.choice(filler)[: rng.randrange(1, 8)].tolist()
        out = other + out if rng.random() < 0.5 else out + other
    return np.array(out or words.tolist(), np.uint64)


def _renamed(words: np.ndarray, names: set[int], rng: random.Random, filler: list[np.ndarray]) -> np.ndarray:
    """A notice of some other licence: the words of a family's names replaced, each by another word or nothing."""
    other = [int(w) for line in filler for w in line[:4].tolist()] or [1]
    out = []
    for w in words.tolist():
        if w not in names:
            out.append(w)
        elif rng.random() < 0.8:
            out.append(rng.choice(other) if rng.random() < 0.5 else rng.getrandbits(63))
    return np.array(out or words.tolist(), np.uint64)


def fit(other_lines: list[str], plan: Plan = DEFAULT) -> Scanner:
    """Train on edited templates against other lines of text."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    own = {f: [plain_words(t) for t in TEMPLATES[f]] for f in families[:-1]}
    vocabulary = np.unique(np.concatenate([np.concatenate(_grams(w)) for ws in own.values() for w in ws]))
    pairs = np.unique(np.concatenate([_grams(w)[1] for ws in own.values() for w in ws]))
    templates = {f: [set(_grams(w)[1].tolist()) for w in ws] for f, ws in own.items()}
    notices = [(plain_words(t), f) for f, ts in SHORT.items() for t in ts]
    long = {w.tobytes() for ws in own.values() for w in ws}  # templates keep the probability of the classifier
    short = {w.tobytes(): f for w, f in notices if w.tobytes() not in long}
    heads = np.unique(np.concatenate([_grams(w)[1][:1] for w, _ in notices]))
    scanner = Scanner(families, vocabulary, np.zeros((len(vocabulary) + 1, len(families))), 1.0, pairs, templates, short, heads)

    frame = {int(x) for x in plain_words(FRAME)}
    rng = random.Random(plan.seed)
    filler = [w for line in other_lines if len(w := plain_words(line)) > 2]
    filler = [w for w in filler if max((scanner.agreement(f, w) for f in families[:-1]), default=0) < plan.agree]
    rows: list[tuple[np.ndarray, int]] = []
    for k, family in enumerate(families[:-1]):
        rows += [(_edit(w, rng, filler), k) for w in own[family] for _ in range(plan.edits)]
    mixed = [int(x) for ws in own.values() for w in ws for x in w]
    names = {f: {int(x) for n in NAMES.get(f, ()) for x in plain_words(n)} - frame for f in families[:-1]}
    for family, ws in own.items():
        for w in ws:
            if any(x in names[family] for x in w.tolist()):
                rows += [(_renamed(w, names[family], rng, filler), len(families) - 1) for _ in range(plan.edits // 4)]
    rows += [(np.array(rng.sample(mixed, rng.randrange(3, 20)), np.uint64), len(families) - 1) for _ in range(len(rows) // 4)]
    rows += [(w, len(families) - 1) for w in filler]
    fresh = np.array([rng.random() < 0.25 for _ in rows])
    x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    for i, (words, _) in enumerate(rows):
        at = scanner.features(words)
        x[i, at] = 1 / np.sqrt(max(len(at), 1))
        x[i, -1] = 1
    y = np.array([k for _, k in rows])
    target = np.eye(len(families), dtype=np.float32)[y]
    w = np.zeros((x.shape[1], len(families)), np.float32)
    speed = np.zeros_like(w)
    for _ in range(plan.steps):
        grad = x[~fresh].T @ (_softmax(x[~fresh] @ w) - target[~fresh]) / (~fresh).sum() + 1e-5 * w
        speed = 0.9 * speed - 4.0 * grad
        w = w + speed
    raw = x[fresh] @ w
    grid = np.exp(np.linspace(-2, 2, 41))
    loss = [-np.log(_softmax(raw / t)[np.arange(len(raw)), y[fresh]] + 1e-12).mean() for t in grid]
    scanner.weights, scanner.temperature = w.astype(np.float64), float(grid[int(np.argmin(loss))])
    return scanner


def scan(docs: DataFrame, plan: Plan = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, family, probability, agreement): licence lines found, numbered from 0 in their text."""
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    count = docs.count()
    drawn = F.pmod(F.xxhash64(F.lit("licences"), "doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 30))
    chosen = texts.filter(drawn < int(min(1.0, SAMPLE_ROWS / max(count, 1)) * (1 << 30)))
    cut = F.transform(F.slice(F.filter(F.split("text", "\n"), lambda x: F.char_length(x) > 20), 1, 2), lambda x: F.substring(x, 1, SAMPLE_CHARS))
    picked = chosen.filter("text is not null").select(cut.alias("lines")).limit(4 * SAMPLE_ROWS).collect()
    lines = sorted({line for r in picked for line in r["lines"]})
    shared = docs.sparkSession.sparkContext.broadcast(fit(lines, plan))
    return texts.mapInArrow(partial(_scan, shared=shared, plan=plan), "doc_id long, line int, family string, probability double, agreement double")


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("agreement", pa.float64())]
)


def _scan(source: Iterator[pa.RecordBatch], shared, plan: Plan) -> Iterator[pa.RecordBatch]:
    scanner: Scanner = shared.value
    quick = np.zeros(1 << 20, bool)
    quick[(scanner.pairs >> np.uint64(44)).astype(np.int64)] = True

    def rows():
        for batch in source:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, found in findings(scanner, text or "", quick, plan):
                    yield doc, i, *found

    yield from batches(rows(), FOUND)


def findings(scanner: Scanner, text: str, quick: np.ndarray, plan: Plan = DEFAULT) -> Iterator[tuple[int, tuple[str, float, float]]]:
    """(line, finding) of a text; a finding of a run stands on its first line."""
    found: dict[int, tuple[str, float, float]] = {}
    for i, words in _lines_near(text, scanner.pairs, quick, scanner.heads):
        if one := classify(scanner, words, plan):
            found[i] = one
    run: list[tuple[int, np.ndarray]] = []

    def whole() -> None:
        if len(run) > 1 and not any(i in found for i, _ in run) and (one := classify(scanner, np.concatenate([w for _, w in run]), plan)):
            found[run[0][0]] = one
        run.clear()

    for i, words in _lines_near(text, scanner.pairs, quick, least=1):
        if run and run[-1][0] != i - 1:
            whole()
        run.append((i, words))
    whole()
    yield from sorted(found.items())


def _lines_near(text: str, pairs: np.ndarray, quick: np.ndarray, heads: np.ndarray | None = None, least: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """Number and words of the lines a finding can be on: those with ``least`` template bigrams, and those that begin with one of ``heads``."""
    marked = text.lower().replace(BREAK, " ").replace("\n", f" {BREAK} ")
    words = word_hashes(marked.encode("utf-8", "replace"), LINED)
    hashes = grams(words, 2)
    breaks = np.flatnonzero(words == BREAK_HASH)
    at = np.flatnonzero(quick[(hashes >> np.uint64(44)).astype(np.int64)])
    at = at[_among(hashes[at], pairs)]
    lines, counts = np.unique(np.searchsorted(breaks, at), return_counts=True)
    lines = lines[counts >= least]
    if heads is not None:
        starts = np.concatenate([[0], breaks + 1])
        starts = starts[starts < len(hashes)]  # breaks are words too, so only the last line can be cut off
        lines = np.union1d(lines, np.flatnonzero(_among(hashes[starts], heads)))
    for i in lines.tolist():
        yield i, words[breaks[i - 1] + 1 if i else 0 : breaks[i] if i < len(breaks) else len(words)]


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def classify(scanner: Scanner, words: np.ndarray, plan: Plan = DEFAULT) -> tuple[str, float, float] | None:
    """Family, probability and agreement of a licence line, or nothing."""
    if family := scanner.short.get(words.tobytes()):
        return family, 1.0, 1.0
    probability = scanner.probabilities(words)
    best = int(np.argmax(probability))
    family = scanner.families[best]
    if family == UNKNOWN or probability[best] < plan.least:
        return None
    agreement = scanner.agreement(family, words)
    return (family, float(probability[best]), agreement) if agreement >= plan.agree else None
