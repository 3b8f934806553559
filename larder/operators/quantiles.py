"""Quantiles of a whole column, exact without gathering its values in one place."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import stage


ACCURACY = 10_000  # of the sketch that brackets a rank: its error is at most one in so many rows
COLLECT = 50_000  # rows in brackets that may come to the driver as distinct values with counts


def exact_quantiles(df: DataFrame, value: Column | str, shares: list[float]) -> dict[float, float | None]:
    """Linearly interpolated quantiles, as ``percentile`` gives them.

    ``percentile`` keeps every distinct value in one aggregation buffer. Here the column is staged by itself, and
    the wanted ranks are closed in: a sketch brackets each rank, one aggregate counts exactly what lies below and inside
    the brackets, and the sketch is drawn again inside them until few rows are left, whose values are counted. A round
    cuts a bracket to some thousandths of its rows, and by one value at least, so a few aggregates over one narrow column
    do for any size, without a sort or an exchange of the values. The driver sees a few values per rank and round, and
    in the end at most ``COLLECT`` values.
    """
    column = F.col(value) if isinstance(value, str) else value
    values = stage(df.select(column.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "quantiles")
    n, least, most = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return {share: None for share in shares}
    places = {share: share * (n - 1) for share in shares}
    ranks = sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))})
    found = _at_ranks(values, dict.fromkeys(ranks, _Bracket(least, most, 0, n)))
    out = {}
    for share, place in places.items():
        a, b = found[math.floor(place)], found[math.ceil(place)]
        out[share] = a + (b - a) * (place - math.floor(place))
    return out


@dataclass(frozen=True)
class _Bracket:
    """Values from ``low`` to ``high``, both included: ``below`` rows lie under them, ``inside`` rows in them."""

    low: float
    high: float
    below: int
    inside: int

    @property
    def condition(self) -> Column:
        return F.col("v").between(F.lit(self.low), F.lit(self.high))


def _at_ranks(values: DataFrame, brackets: dict[int, _Bracket]) -> dict[int, float]:
    """Value at each 0-based rank."""
    found = {r: b.low for r, b in brackets.items() if b.low == b.high}
    while open_ := {r: b for r, b in brackets.items() if r not in found}:
        distinct = set(open_.values())
        if sum(b.inside for b in distinct) <= COLLECT:
            inside = reduce(or_, (b.condition for b in distinct))
            counted = sorted(map(tuple, values.where(inside).groupBy("v").agg(F.count(F.lit(1)).alias("c")).collect()))
            for r, b in open_.items():
                upto = b.below
                for v, c in counted:
                    if b.low <= v <= b.high:
                        upto += c
                        if r < upto:
                            found[r] = v
                            break
            break
        brackets = _narrowed(values, open_)
        found |= {r: b.low for r, b in brackets.items() if b.low == b.high}
    return found


def _narrowed(values: DataFrame, brackets: dict[int, _Bracket]) -> dict[int, _Bracket]:
    """Each bracket cut to what a sketch of its rows leaves possible, with exact counts."""
    sketches = []
    for r, b in brackets.items():
        at = (r - b.below) / b.inside
        shares = [min(1.0, max(0.0, at + d / ACCURACY)) for d in (-2, 2)]
        sketches.append(F.percentile_approx(F.when(b.condition, F.col("v")), shares, ACCURACY).alias(str(r)))
    bounds = values.agg(*sketches).first()
    tried = {r: tuple(bounds[str(r)]) for r in brackets}
    v = F.col("v")
    facts = {
        "b": lambda low, high: F.count_if(v < low), "i": lambda low, high: F.count_if(v.between(low, high)),
        "l": lambda low, high: F.count_if(v == low), "n": lambda low, high: F.min(F.when(v > low, v)),
    }
    counts = values.agg(*[f(F.lit(low), F.lit(high)).alias(f"{k}{r}") for r, (low, high) in tried.items() for k, f in facts.items()]).first()
    out = {}
    for r, (low, high) in tried.items():
        below, inside, least, old = counts[f"b{r}"], counts[f"i{r}"], counts[f"l{r}"], brackets[r]
        if r < below:  # a sketch that misses its error leaves the bracket as it was on that side
            out[r] = _Bracket(old.low, math.nextafter(low, -math.inf), old.below, below - old.below)
        elif r >= below + inside:
            out[r] = _Bracket(math.nextafter(high, math.inf), old.high, below + inside, old.below + old.inside - below - inside)
        elif r < below + least:
            out[r] = _Bracket(low, low, below, least)
        else:  # at least the lowest value leaves the bracket, so every round comes nearer
            out[r] = _Bracket(counts[f"n{r}"], high, below + least, inside - least)
    return out


def approx_quantile(value: Column, share: float, accuracy: int = 10_000) -> Column:
    """Aggregate for callers who accept a rank error of n / accuracy."""
    return F.percentile_approx(value, share, accuracy)
