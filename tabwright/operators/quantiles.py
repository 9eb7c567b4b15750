"""Exact quantiles without holding a column in one task.

`percentile` keeps every distinct value of a column in one aggregation buffer.
Here a sample brackets each wanted rank, one code-generated aggregate counts
the rows below, at the ends of and inside every bracket, and only brackets that
do not settle by those counts are looked into.  A bracket that holds too many
rows is narrowed by a sample of its own rows; one that missed its rank is
widened.  Samples decide only where to look: the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import floor, inf, nextafter, sqrt

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import col, count_where

SAMPLE_ROWS = 100_000
BRACKET_ROWS = 1_000_000
ACCURACY = 10_000
SIGMAS = 5.0


@dataclass(eq=False)
class _Bracket:
    """An interval of one column that should hold the order statistics `ranks`."""

    column: str
    size: int
    ranks: tuple[int, ...]
    low: float
    high: float
    ends: tuple[float, float]
    slack: float = SIGMAS
    base: int = 0           # rows below `low`
    inside: int = 0
    stuck: bool = False     # the last narrowing changed nothing
    found: dict[int, float] = field(default_factory=dict)

    @property
    def open(self) -> list[int]:
        return [k for k in dict.fromkeys(self.ranks) if k not in self.found]

    def test(self):
        return (col(self.column) >= self.low) & (col(self.column) <= self.high)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    sample_rows: int = SAMPLE_ROWS,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, as `percentile` defines them."""
    floats = {c for c, t in df.dtypes if t in ("float", "double")}
    number = lambda c: F.when(~F.isnan(col(c)), col(c).cast("double")) if c in floats else col(c).cast("double")
    data = df.select(*[number(c).alias(c) for c in columns])  # NaN is a missing value
    row = data.agg(
        *[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    ).first()
    size = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    first = {(c, p): floor(p * (size[c] - 1)) for c in columns if size[c] for p in probs}
    ranks = {k: (v, min(v + 1, size[k[0]] - 1)) for k, v in first.items()}
    todo = []
    for i, c in enumerate(columns):
        if not size[c]:
            continue
        ends = (row[f"a{i}"], row[f"b{i}"])
        pairs = [ranks[(c, p)] for p in probs]
        if size[c] <= bracket_rows:  # few rows: one bracket for all ranks
            pairs = [tuple(sorted({k for pair in pairs for k in pair}))]
        todo += [_Bracket(c, size[c], pair, *ends, ends, inside=size[c]) for pair in pairs]
    brackets = list(todo)
    for b in todo:
        if b.low == b.high:
            b.found = {k: b.low for k in b.ranks}
    todo = [b for b in todo if b.open]
    _select(data, [b for b in todo if b.inside <= bracket_rows])
    while todo := [b for b in todo if b.open]:
        stuck = [b for b in todo if b.stuck]
        _trim(data, stuck)
        _narrow(data, [b for b in todo if b.open and b not in stuck], sample_rows)
        _count(data, [b for b in todo if b.open])
        _select(data, [b for b in todo if b.open and b.inside <= bracket_rows])

    known = {(b.column, k): v for b in brackets for k, v in b.found.items()}

    def value(c: str, p: float) -> float | None:
        if not size[c]:
            return None
        low, high = ranks[(c, p)]
        part = p * (size[c] - 1) - low
        return known[(c, low)] if part == 0 else known[(c, low)] * (1 - part) + known[(c, high)] * part

    return {c: [value(c, p) for p in probs] for c in columns}


def _narrow(data: DataFrame, brackets: list[_Bracket], sample_rows: int) -> None:
    """Move each bracket around its ranks, by quantiles of a sample of its rows."""
    if not brackets:
        return
    share = min(1.0, sample_rows / min(b.inside for b in brackets))
    sample = data if share == 1.0 else data.sample(share, seed=17)
    by_column: dict[tuple, list[float]] = {}
    wanted = []
    for b in brackets:
        drawn = max(b.inside * share, 1.0)
        step = b.slack * (sqrt(0.25 / drawn) if share < 1.0 else 0.0) + 2.0 / ACCURACY
        start = max((b.ranks[0] - b.base) / b.inside - step, 0.0)
        stop = min((b.ranks[-1] - b.base + 1) / b.inside + step, 1.0)
        by_column.setdefault((b.column, b.low, b.high), []).extend([start, stop])
        wanted.append((b, (b.column, b.low, b.high), start, stop))
    keys = list(by_column)
    exprs = []
    for i, (c, low, high) in enumerate(keys):
        x = F.when((col(c) >= low) & (col(c) <= high), col(c))
        exprs.append(F.percentile_approx(x, by_column[(c, low, high)], ACCURACY).alias(f"p{i}"))
    got = sample.agg(*exprs).first()
    for b, key, start, stop in wanted:
        values = got[f"p{keys.index(key)}"]
        at = dict(zip(by_column[key], values or []))
        low, high = (b.low if start <= 0 or not at else at[start]), (b.high if stop >= 1 or not at else at[stop])
        b.stuck = (low, high) == (b.low, b.high)
        b.low, b.high = low, high


def _count(data: DataFrame, brackets: list[_Bracket]) -> None:
    """Rows below and inside each bracket; a one-value bracket settles by them."""
    if not brackets:
        return
    row = data.agg(*[
        e for i, b in enumerate(brackets)
        for e in (count_where(col(b.column) < b.low).alias(f"below{i}"), count_where(b.test()).alias(f"in{i}"))
    ]).first()
    for i, b in enumerate(brackets):
        b.base, b.inside = row[f"below{i}"], row[f"in{i}"]
        if any(not b.base <= k < b.base + b.inside for k in b.open):
            b.low, b.high = b.ends  # the sample missed: start again with more slack
            b.base, b.inside, b.slack, b.stuck = 0, b.size, b.slack * 4, False
        elif b.low == b.high:
            b.found |= {k: b.low for k in b.open}


def _trim(data: DataFrame, brackets: list[_Bracket]) -> None:
    """Cut the smallest and largest value, often heavy ones, off brackets no sample can narrow."""
    if not brackets:
        return
    row = data.agg(*[
        f(F.when(b.test(), col(b.column))).alias(f"{k}{i}") for i, b in enumerate(brackets) for k, f in (("a", F.min), ("b", F.max))
    ]).first()
    for i, b in enumerate(brackets):
        b.low, b.high = row[f"a{i}"], row[f"b{i}"]
    row = data.agg(*[
        e for i, b in enumerate(brackets)
        for e in (count_where(col(b.column) == b.low).alias(f"low{i}"), count_where(col(b.column) == b.high).alias(f"high{i}"))
    ]).first()
    for i, b in enumerate(brackets):
        at_low, at_high = row[f"low{i}"], row[f"high{i}"]
        for k in b.open:
            if k < b.base + at_low:
                b.found[k] = b.low
            elif k >= b.base + b.inside - at_high:
                b.found[k] = b.high
        b.ranks = tuple(b.open) or b.ranks
        b.base, b.inside, b.stuck = b.base + at_low, b.inside - at_low - at_high, False
        b.low, b.high = nextafter(b.low, inf), nextafter(b.high, -inf)


def _select(data: DataFrame, brackets: list[_Bracket]) -> None:
    """Order statistics inside brackets of bounded size."""
    if not brackets:
        return
    spans: list[list] = []  # disjoint [column, low, high, base, ranks]
    for b in sorted(brackets, key=lambda b: (b.column, b.low, b.high)):
        if spans and spans[-1][0] == b.column and b.low <= spans[-1][2]:
            spans[-1][2] = max(spans[-1][2], b.high)
            spans[-1][4] |= set(b.open)
        else:
            spans.append([b.column, b.low, b.high, b.base, set(b.open)])
    hits, parts = F.lit(False), []
    names = dict.fromkeys(s[0] for s in spans)
    for c in names:
        number = F.lit(None).cast("int")
        for i, (name, low, high, _, _) in enumerate(spans):
            if name == c:
                here = (col(c) >= low) & (col(c) <= high)
                hits, number = hits | here, F.when(here, i).otherwise(number)
        parts += [number, col(c)]
    counts = (
        data.where(hits)
        .select(F.stack(F.lit(len(names)), *parts).alias("span", "v"))
        .where(F.col("span").isNotNull())
        .groupBy("span", "v")
        .agg(F.count("*").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("v"))
    placed = counts.withColumn("stop", upto).withColumn("start", F.col("stop") - F.col("n"))
    ranks = F.array(*[F.array(*[F.lit(k - s[3]) for k in sorted(s[4])]) for s in spans])
    wanted = placed.where(F.exists(ranks[F.col("span")], lambda k: (F.col("start") <= k) & (k < F.col("stop"))))
    for r in wanted.collect():  # at most one row per rank
        c, _, _, base, open_ = spans[r["span"]]
        for k in open_:
            if r["start"] <= k - base < r["stop"]:
                for b in brackets:
                    if b.column == c and k in b.ranks:
                        b.found[k] = r["v"]
