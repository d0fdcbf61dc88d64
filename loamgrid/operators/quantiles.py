"""Exact quantiles of large columns without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.expressions import finite

#: Bins into which a stretch of values is split a round, and the values of a stretch that are few enough to be listed.
BINS, LISTED = 1024, 4096


@dataclass
class _Rank:
    """A value wanted by its rank, known to lie in [lo, hi]; ``below`` values are less than lo, ``n`` lie in the stretch."""

    column: int
    rank: int
    lo: float
    hi: float
    below: int
    n: int

    @property
    def stretch(self) -> tuple:
        return self.column, self.lo, self.hi


def _by_stretch(rows: DataFrame, stretches: Sequence[tuple], part) -> DataFrame:
    """``id, part`` of each value in each stretch, from one reading of the rows."""
    each = []
    for i, (c, lo, hi) in enumerate(stretches):
        x = F.col(f"x{c}")
        each.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("id"), part(x, lo, hi).alias("part"), x.alias("x"))))
    return rows.select(F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.*")


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float | Callable[[int], int]]) -> dict[str, list[float | None]]:
    """The quantiles of each column (between two values on the straight line), exact; None for a column without a finite value.

    A share may also be a function of the number of values that gives a rank from 0: the value at that rank.

    1. A sketch, combined map-side, brackets each quantile. 2. One pass counts what lies below and inside the brackets. 3. A bracket with
    more than LISTED values is split into BINS bins that are counted, and only the bin that holds the rank goes on, until
    its values are few or equal. The driver gets counts and at most LISTED values a quantile; no task gathers a column.
    """
    names = list(columns)
    rows = df.select(*(finite(c.cast("double")).alias(f"x{i}") for i, c in enumerate(columns.values())))
    near = sorted({s for p in shares if not callable(p) for s in (max(0.0, p - 2e-4), min(1.0, p + 2e-4))} or {0.5})
    ends = rows.agg(*(f for i in range(len(names)) for f in (F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"a{i}"), F.max(f"x{i}").alias(f"b{i}"), F.percentile_approx(f"x{i}", near, 10_000).alias(f"q{i}")))).first()
    wanted: dict[tuple[int, int], _Rank | float] = {}
    todo, brackets = [], {}
    for i in range(len(names)):
        n = ends[f"n{i}"]
        if not n:
            continue
        for p in shares:
            if callable(p):
                todo.append(_Rank(i, p(n), ends[f"a{i}"], ends[f"b{i}"], 0, n))
                continue
            lo, hi = (ends[f"q{i}"][near.index(s)] for s in (max(0.0, p - 2e-4), min(1.0, p + 2e-4)))
            lo, hi = (ends[f"a{i}"] if p <= 2e-4 else lo), (ends[f"b{i}"] if p >= 1 - 2e-4 else hi)
            brackets[i, lo, hi] = None
            for k in {math.floor(p * (n - 1)), min(n - 1, math.floor(p * (n - 1)) + 1)}:
                todo.append(_Rank(i, k, lo, hi, 0, n))
    if brackets:
        counts = rows.agg(*(f for j, (i, lo, hi) in enumerate(brackets) for f in (F.count(F.when(F.col(f"x{i}") < lo, 1)).alias(f"u{j}"), F.count(F.when(F.col(f"x{i}").between(lo, hi), 1)).alias(f"v{j}")))).first()
        place = {b: j for j, b in enumerate(brackets)}
        for t in todo:
            if t.stretch not in place:
                continue
            j = place[t.stretch]
            if counts[f"u{j}"] <= t.rank < counts[f"u{j}"] + counts[f"v{j}"]:
                t.below, t.n = counts[f"u{j}"], counts[f"v{j}"]
            else:
                t.lo, t.hi = ends[f"a{t.column}"], ends[f"b{t.column}"]
    while todo:
        for t in todo:
            if t.lo == t.hi:
                wanted[t.column, t.rank] = t.lo
        todo = [t for t in todo if t.lo < t.hi]
        few, many = [t for t in todo if t.n <= LISTED], [t for t in todo if t.n > LISTED]
        if few:
            stretches = list(dict.fromkeys(t.stretch for t in few))
            got: dict[int, list] = {}
            for r in _by_stretch(rows, stretches, lambda x, lo, hi: F.lit(0)).groupBy("id", "x").agg(F.count("*").alias("n")).collect():
                got.setdefault(r.id, []).append((r.x, r.n))
            for t in few:
                left = t.rank - t.below
                for x, n in sorted(got[stretches.index(t.stretch)]):
                    if left < n:
                        wanted[t.column, t.rank] = x
                        break
                    left -= n
        if many:
            stretches = list(dict.fromkeys(t.stretch for t in many))
            # In halves, so that the width stays finite.
            bin_of = lambda x, lo, hi: F.least(F.lit(BINS - 1), F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)).cast("int")
            bins: dict[int, list] = {}
            for r in _by_stretch(rows, stretches, bin_of).groupBy("id", "part").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect():
                bins.setdefault(r.id, []).append((r.part, r.n, r.a, r.b))
            for t in many:
                for _, n, a, b in sorted(bins[stretches.index(t.stretch)]):
                    if t.rank < t.below + n:
                        t.lo, t.hi, t.n = a, b, n
                        break
                    t.below += n
        todo = many
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        n, got = ends[f"n{i}"], []
        for p in shares:
            if not n:
                got.append(None)
                continue
            if callable(p):
                got.append(wanted[i, p(n)])
                continue
            at = p * (n - 1)
            k = math.floor(at)
            a, b = wanted[i, k], wanted[i, min(n - 1, k + 1)]
            got.append(a + (b - a) * (at - k))
        out[name] = got
    return out
