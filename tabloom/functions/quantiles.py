"""Exact linear-interpolated quantiles that do not gather a column in one task.

Spark's ``percentile`` keeps every distinct value of a column in one aggregation buffer. Here each
wanted order statistic is bracketed by ``percentile_approx`` and the ranks of the bracket ends are
counted exactly; the bracket shrinks by three orders of magnitude per round until its few values can
be listed, at once for a short column. The sketch only chooses the bracket, so its error never reaches
the result. Infinite values are counted at both ends and never searched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.buckets import add_slots, just_above
from tabloom.functions.columns import as_list, col, number
from tabloom.functions.ordering import running_totals

GROUP_VALUES = 500_000
"""Values of a group up to which the built-in exact percentile is used for groups."""
LISTED_VALUES = 10_000
ACCURACY = 10_000


@dataclass
class _Search:
    """One wanted order statistic: ``rank`` (0-based) of ``column`` lies strictly between low and high."""

    column: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self) -> Column:
        x = _finite(self.column)
        keep = x.isNotNull()
        if self.low is not None:
            keep = keep & (x > F.lit(self.low))
        if self.high is not None:
            keep = keep & (x < F.lit(self.high))
        return F.when(keep, x)


def _finite(name: str) -> Column:
    x = number(name)
    return F.when(F.abs(x) < F.lit(math.inf), x)


def exact_quantiles(df: DataFrame, columns: str | Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column over its non-null values; None for an empty column."""
    names = as_list(columns)
    if not names or not probabilities:
        return {n: [] for n in names}
    sizes = df.agg(
        *[
            F.struct(F.count(number(n)).alias("all"), F.count(_finite(n)).alias("finite"), F.count_if(number(n) == -math.inf).alias("least")).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    ).first()
    counts = [c["all"] for c in sizes]
    searches: dict[tuple[str, int], _Search] = {}
    places = {}
    for i, n in enumerate(names):
        for p in probabilities:
            if counts[i] == 0:
                continue
            place = float(p) * (counts[i] - 1)
            lower = min(max(math.floor(place), 0), counts[i] - 1)
            places[n, p] = (lower, place - lower)
            for rank in {lower, min(lower + (place > lower), counts[i] - 1)}:
                least, finite = sizes[i]["least"], sizes[i]["finite"]
                search = searches.setdefault((n, rank), _Search(n, rank - least, 0, finite))
                if not 0 <= search.rank < finite:
                    search.value = -math.inf if rank < least else math.inf
    _resolve(df, list(searches.values()))
    result = {}
    for n in names:
        result[n] = []
        for p in probabilities:
            if (n, p) not in places:
                result[n].append(None)
                continue
            lower, part = places[n, p]
            low = searches[n, lower].value
            high = searches[n, lower + 1].value if part > 0 else low
            result[n].append(low if low == high else (1 - part) * low + part * high)
    return result


def _resolve(df: DataFrame, searches: list[_Search]) -> None:
    while True:
        open_ = [s for s in searches if s.value is None]
        wide = [s for s in open_ if s.inside > LISTED_VALUES]
        if not wide:
            break
        _narrow(df, wide)
    if open_:
        # Every list here has at most LISTED_VALUES entries.
        spans = list({(s.column, s.low, s.high): s for s in open_}.values())
        row = df.agg(*[F.array_sort(F.collect_list(s.within())).alias(f"v{i}") for i, s in enumerate(spans)]).first()
        lists = {(s.column, s.low, s.high): row[i] for i, s in enumerate(spans)}
        for s in open_:
            s.value = lists[s.column, s.low, s.high][s.rank - s.below]


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """One sketch pass and one counting pass over all open searches."""
    spans: dict[tuple, list[list[_Search]]] = {}
    for s in sorted(searches, key=lambda s: s.rank):
        runs = spans.setdefault((s.column, s.low, s.high), [])
        # Neighbouring ranks (the two ends of an interpolation) share a bracket.
        if runs and s.rank - runs[-1][-1].rank <= 1:
            runs[-1].append(s)
        else:
            runs.append([s])
    sketches = []
    for i, runs in enumerate(spans.values()):
        marks = []
        for run in runs:
            for s, margin in ((run[0], -2.0), (run[-1], 2.0)):
                at = (s.rank - s.below + 0.5) / s.inside + margin / ACCURACY
                marks.append(F.lit(min(max(at, 0.0), 1.0)))
        sketches.append(
            F.percentile_approx(runs[0][0].within(), F.array(*marks), F.lit(ACCURACY)).alias(f"a{i}")
        )
    sketched = df.agg(*sketches).first()
    brackets = []
    ends: dict[str, set[float]] = {}
    for i, runs in enumerate(spans.values()):
        for j, run in enumerate(runs):
            a, b = sketched[i][2 * j : 2 * j + 2]
            brackets += [(s, a, b) for s in run]
            ends.setdefault(runs[0][0].column, set()).update((a, b))
    ranks = _ranks(df, {c: sorted(e) for c, e in ends.items()})
    for s, a, b in brackets:
        under_a, upto_a = ranks[s.column, a]
        under_b, upto_b = ranks[s.column, b]
        if under_a <= s.rank < upto_a:
            s.value = a
        elif under_b <= s.rank < upto_b:
            s.value = b
        elif s.rank < under_a:
            s.high, s.inside = a, under_a - s.below
        elif s.rank >= upto_b:
            s.inside -= upto_b - s.below
            s.low, s.below = b, upto_b
        else:
            s.low, s.high, s.below, s.inside = a, b, upto_a, under_b - upto_a


def _ranks(df: DataFrame, ends: dict[str, list[float]]) -> dict[tuple[str, float], tuple[int, int]]:
    """For every end the number of values below it and up to it.

    Values are counted per slot between the ends, where every end has a slot of its own, so the cost
    of a row grows with the logarithm of the number of ends.
    """
    splits = {c: sorted({s for e in es for s in (e, just_above(e))}) for c, es in ends.items()}
    slotted = add_slots(
        df.select(*[_finite(c).alias(f"x{i}") for i, c in enumerate(ends)]),
        {f"s{i}": (F.col(f"x{i}"), splits[c]) for i, c in enumerate(ends)},
    )
    counted = (
        slotted.select(F.posexplode(F.array(*[f"s{i}" for i in range(len(ends))])).alias("c", "slot"))
        .where("slot IS NOT NULL")
        .groupBy("c", "slot")
        .agg(F.count("*").alias("n"))
    )
    found = {(r["c"], r["slot"]): r["n"] for r in counted.collect()}
    ranks = {}
    for i, (name, es) in enumerate(ends.items()):
        # upto[k] counts the values below the k-th split point.
        upto = list(accumulate(found.get((i, k), 0) for k in range(len(splits[name]) + 1)))
        at = {s: k for k, s in enumerate(splits[name])}
        for e in es:
            ranks[name, e] = (upto[at[e]], upto[at[just_above(e)]])
    return ranks


def group_quantiles(
    df: DataFrame,
    group_by: str | Sequence[str],
    column: str,
    probabilities: Sequence[float],
    group_rows: int = GROUP_VALUES,
) -> DataFrame:
    """One row per group with columns ``q0, q1, …``; groups of any size.

    With a group above ``group_rows`` the values are counted, range-sorted over all tasks, and the
    wanted ranks picked from the running counts.
    """
    groups = as_list(group_by)
    keys = [col(g) for g in groups]
    x = number(column)
    largest = df.groupBy(*keys).agg(F.count(x).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= group_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        picked = df.groupBy(*keys).agg(F.percentile(x, wanted).alias("_q"))
        return picked.select(*keys, *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probabilities))])
    counted = df.where(x.isNotNull()).groupBy(*keys, x.alias("_v")).agg(F.count("*").alias("_n"))
    running = running_totals(counted, "_v", {"_upto": "_n"}, groups)
    totals = df.groupBy(*[col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(F.count(x).alias("_total"))
    match = F.lit(True)
    for i, g in enumerate(groups):
        match = match & col(g).eqNullSafe(F.col(f"_g{i}"))
    placed = running.join(totals, match)
    picks, outputs = [], []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        lower = F.floor(place)
        upper = F.least(lower + 1, F.col("_total") - 1)
        for tag, rank in (("l", lower), ("h", upper)):
            here = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}{i}"))
        picks.append(F.max(place - lower).alias(f"_p{i}"))
        low, high, part = F.col(f"_l{i}"), F.col(f"_h{i}"), F.col(f"_p{i}")
        outputs.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(f"q{i}"))
    found = placed.groupBy(*keys).agg(*picks).select(*keys, *outputs)
    empty = totals.where(F.col("_total") == 0).select(
        *[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)],
        *[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probabilities))],
    )
    return found.unionByName(empty)
