"""Rows as cells of binned features, for regression trees of many rows.

A tree that splits binned features depends on the number of rows and the sum of targets of each cell (rows of equal
bins) alone.  `fold_cuts` finds the bins of all folds in one scan, `coded` numbers the cell of every row, `cell_sums`
adds rows up by cell: as they are, and for each tree of a forest times the row's Poisson draw, so that every row is
drawn on its own.  All of it is expressions and aggregates of Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import exp, factorial

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..functions.sizing import rows_if_bounded

DRAWN_AT_ONCE = 5  # trees; the code for 20 of them is too long to be compiled (37 s in place of 4 x 1.3 s for 36 million rows)
CANDIDATES = 32  # values for each bin that may become a cut of a feature with many values, at equal steps in rank
MOST_FEATURES = 60  # with two values each, codes of more do not fit a number


def fold_cuts(table: DataFrame, features: Sequence[str], folds: int, bins: int) -> tuple[int, list[list[np.ndarray]]] | None:
    """(rows, cuts of every feature for every fold), None when a feature has nulls, NaN or infinity, or there are too many.

    A value belongs to the bin of as many cuts as are at most the value.  A feature of at most `bins` values is cut
    between any two of them, another one into `bins` bins of equal row count outside the fold.  These cuts are chosen
    by counts of all rows outside the fold from the same values for all folds, CANDIDATES for each bin, so that folds
    hardly differ in their cuts.
    """
    if not 0 < len(features) <= MOST_FEATURES:
        return None
    x = [col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = table.select(col("__fold").alias("fold"), *x)
    names = rows.columns[1:]
    holes = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) for c in names]
    count, *found = rows.agg(F.count("*"), *holes, *[F.approx_count_distinct(c) for c in names]).first()
    if any(found[: len(names)]):
        return None
    cuts: dict[int, list[np.ndarray]] = {}  # feature -> cuts for each fold
    for i, (c, seen) in enumerate(zip(names, found[len(names) :])):
        few = rows_if_bounded(rows.select(F.col(c).alias("v")).distinct(), bins) if seen <= 2 * bins else None
        if few is not None:
            cuts[i] = [np.array(sorted(r["v"] for r in few)[1:])] * folds
    wide = [i for i in range(len(names)) if i not in cuts]
    shares = F.lit([j / (CANDIDATES * bins) for j in range(CANDIDATES * bins)])
    ranked = rows.agg(*[F.percentile_approx(names[i], shares, 10 * CANDIDATES * bins) for i in wide]).first() if wide else ()
    grids = {i: np.unique(values) for i, values in zip(wide, ranked)}
    if grids:
        placed = Bucketizer(
            inputCols=[names[i] for i in grids], outputCols=[f"b{i}" for i in grids], splitsArray=[[float("-inf"), *g.tolist(), float("inf")] for g in grids.values()]
        ).transform(rows)
        step = max(map(len, grids.values())) + 1
        place = F.explode(F.array(*[F.col(f"b{i}").cast("int") + i * step for i in grids])).alias("place")
        counts = np.zeros((len(names), folds, step))
        for r in placed.select("fold", place).groupBy("fold", "place").count().collect():  # at most folds x features x candidates rows
            counts[r["place"] // step, r["fold"], r["place"] % step] = r["count"]
        for i, grid in grids.items():
            below = np.cumsum(counts[i], axis=1)[:, : len(grid)]  # rows of each fold that are less than a value of the grid
            cuts[i] = []
            for k in range(folds):
                outside = below.sum(0) - below[k]
                rank = np.arange(1, bins) / bins * (counts[i].sum() - counts[i, k].sum())
                cuts[i].append(grid[np.unique(np.maximum(np.searchsorted(outside, rank) - 1, 0))])
    return count, [[cuts[i][k] for i in range(len(names))] for k in range(folds)]


def coded(table: DataFrame, target: str, features: Sequence[str], edges: Sequence[np.ndarray], folds: int) -> DataFrame:
    """(code, y) of every row: the bins by `edges` as digits of one number, the fold as the last; `bins_of` reads it."""
    rows = table.select(col("__fold").alias("fold"), col(target).cast("double").alias("y"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    cut = [i for i, e in enumerate(edges) if len(e)]
    if cut:
        splits = [[float("-inf"), *edges[i].tolist(), float("inf")] for i in cut]
        rows = Bucketizer(inputCols=[f"x{i}" for i in cut], outputCols=[f"b{i}" for i in cut], splitsArray=splits).transform(rows)
    digits = [(len(e) + 1, F.col(f"b{i}").cast("long") if len(e) else F.lit(0).cast("long")) for i, e in enumerate(edges)]
    code = reduce(lambda a, d: a * F.lit(d[0]) + d[1], digits, F.lit(0).cast("long"))
    return rows.select((code * F.lit(folds) + F.col("fold")).alias("code"), "y")


def bins_of(edges: Sequence[np.ndarray], cuts: Sequence[np.ndarray], folds: int) -> list[Column]:
    """The bins by `cuts`, a part of `edges`, of each feature of a code, as doubles."""
    out, step = [], folds
    for e, c in reversed(list(zip(edges, cuts))):
        fine = F.expr(f"(code div {step}L) % {len(e) + 1}L")
        rough = np.concatenate([[0], np.searchsorted(c, e, side="right")])
        same = (rough == np.arange(len(rough))).all()
        out.append((fine if same else F.lit(rough.tolist())[fine.cast("int")]).cast("double"))
        step *= len(e) + 1
    return out[::-1]


def cell_sums(rows: DataFrame) -> DataFrame:
    """(code, n, s): rows and sum of targets of each code."""
    return rows.groupBy("code").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"))


def drawn_sums(rows: DataFrame, draws: Sequence[tuple[int, int, float]]) -> list[DataFrame]:
    """(code, w0, s0, w1, s1, ...) in tables of DRAWN_AT_ONCE trees: drawn rows and sum of their targets of each code.

    `draws`: (seed, trees, rate) of forests; a tree sees a row as often as a Poisson draw of this rate says.  Draws
    follow the seed, the tree, the partition and the place in it, as those of `pyspark.ml` do.
    """
    each = enumerate((seed, rate) for seed, n, rate in draws for _ in range(n))
    trees = [(int(np.random.SeedSequence([seed % 2**63, t]).generate_state(1, np.uint64)[0] >> 1), rate) for t, (seed, rate) in each]
    tables = []
    for at in range(0, len(trees), DRAWN_AT_ONCE):
        some = dict(enumerate(trees[at : at + DRAWN_AT_ONCE], at))
        even = rows.select("code", "y", *[F.rand(seed).alias(f"r{t}") for t, (seed, _) in some.items()])
        times = even.select("code", "y", *[poisson(F.col(f"r{t}"), rate).alias(f"w{t}") for t, (_, rate) in some.items()])
        tables.append(times.groupBy("code").agg(*[F.sum(v).alias(f"{c}{t}") for t in some for c, v in (("w", F.col(f"w{t}")), ("s", F.col(f"w{t}") * F.col("y")))]))
    return tables


def poisson(even: Column, rate: float) -> Column:
    """A Poisson draw from an even one between 0 and 1."""
    shares = np.cumsum([exp(-rate) * rate**i / factorial(i) for i in range(40)])
    limits = shares[shares < 1 - 1e-15].tolist()
    first, *others = [(even < limit, float(times)) for times, limit in enumerate(limits)]
    return reduce(lambda c, o: c.when(*o), others, F.when(*first)).otherwise(float(len(limits)))
