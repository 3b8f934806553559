"""Tagging of request texts by what they ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words looked for, in order of precedence, and the intent each means.
INTENT_WORDS = [
    ("understock", "understocked"),
    ("reorder", "reorder"),
    ("forecast", "forecast"),
    ("demand", "forecast"),
]


def intent(text: Column) -> Column:
    lowered = F.lower(text)
    out = None
    for word, name in INTENT_WORDS:
        hit = lowered.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")
