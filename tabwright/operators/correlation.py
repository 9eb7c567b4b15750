"""Association between columns: Pearson r, leakage checks, group effects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, has_word, numeric_columns
from .profiling import per_column

#: Columns of one matrix: a task holds four of their square.
WIDEST = 2_000
#: A variance below this share of the column's own is rounding of a constant.
SLIGHT = 1e-12


def _r(a, b):
    """Pearson r; constant columns give NULL rather than NaN."""
    r = F.corr(a.cast("double"), b.cast("double"))
    return F.when(~F.isnan(r), r)


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, r, abs_r, rank) of every numeric column with the target."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    table = per_column(df, columns, {"r": lambda c: _r(col(c), col(target))})
    strength = Window.orderBy(F.desc_nulls_last("abs_r"), "column_name")  # one row per column
    return table.withColumn("abs_r", F.abs("r")).withColumn("rank", F.row_number().over(strength))


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line, n, sx, sy, sxx, syy, sxy): for each column arrays over all columns, of rows that have both.

    One matrix product of values, squares and marks of presence for each batch of rows; values are centred
    and scaled by their column first.  Tasks emit one line for each column, which Spark adds up.
    """
    values = [col(c).cast("double") for c in columns]
    known = [F.when(~F.isnan(v), v) for v in values]
    row = df.agg(*[f(v) for f in (F.avg, F.stddev_pop) for v in known]).first()
    held = np.array([np.nan if v is None else v for v in row], float)
    mean, scale = np.nan_to_num(held[: len(columns)]), held[len(columns) :]
    scale = np.where(scale > 0, scale, 1.0)
    names, width = ("n", "sx", "sy", "sxx", "syy", "sxy"), len(columns)
    schema = "line int, " + ", ".join(f"{c} array<double>" for c in names)

    def as_batch(parts: list[np.ndarray], lines) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.int32()), *[pa.array(list(p), pa.list_(pa.float64())) for p in parts]], names=["line", *names])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((width, width)) for _ in range(4))
        for b in batches:
            if not b.num_rows:
                continue
            x = (b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) - mean) / scale
            there = ~np.isnan(x)
            z, m = np.where(there, x, 0.0), there.astype(float)
            n += m.T @ m
            sx += z.T @ m
            sxx += (z * z).T @ m
            sxy += z.T @ z
        if n.any():
            yield as_batch([n, sx, sx.T, sxx, sxx.T, sxy], range(width))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            lines = np.stack([b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in names], 1) if b.num_rows else []
            for line, values in zip(b.column("line").to_pylist(), lines):
                total[line] = total.get(line, 0) + values
        if total:
            yield as_batch([np.stack([v[k] for v in total.values()]) for k in range(len(names))], list(total))

    vector = F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in known])
    return df.select(vector.alias("x")).mapInArrow(products, schema).repartition("line").mapInArrow(added, schema)


def correlated_pairs(df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None) -> DataFrame:
    """(left_column, right_column, abs_r) for pairs above the threshold: one scan for all pairs, after one for the means.

    A pair counts the rows that have both; up to WIDEST columns in one go, more as pairs of blocks.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) > WIDEST:
        half = WIDEST // 2
        blocks = [columns[i : i + half] for i in range(0, len(columns), half)]
        between = [_pairs(df, a + b, threshold, len(a)) for a, b in combinations(blocks, 2)]
        return reduce(DataFrame.unionByName, [*[_pairs(df, b, threshold) for b in blocks], *between])
    return _pairs(df, columns, threshold)


def _pairs(df: DataFrame, columns: list[str], threshold: float, first: int | None = None) -> DataFrame:
    """Pairs of columns; with `first` those of one of the first columns and one of the others."""
    names = F.array(*[F.lit(c) for c in columns])
    each = F.transform("n", lambda n, j: F.struct(j.alias("j"), n.alias("n"), *[F.get(F.col(c), j).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")]))
    wanted = F.col("j") > F.col("line") if first is None else (F.col("line") < first) & (F.col("j") >= first)
    vx, vy = (F.col(f"s{a}{a}") - F.col(f"s{a}") * F.col(f"s{a}") / F.col("n") for a in "xy")
    varied = (F.col("n") > 1) & (vx > SLIGHT * F.col("n")) & (vy > SLIGHT * F.col("n"))
    r = F.when(varied, F.abs((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)))
    pairs = pair_sums(df, columns).select("line", F.inline(each)).where(wanted)
    return pairs.select(F.get(names, F.col("line")).alias("left_column"), F.get(names, F.col("j")).alias("right_column"), r.alias("abs_r")).where(F.col("abs_r") > threshold)


def leakage(df: DataFrame, target: str, threshold: float = 0.99) -> DataFrame:
    """(column_name, abs_r, reason): features too close to the target, by value or by name."""
    table = target_correlation(df, target).select("column_name", "abs_r")
    by_value = table.where(F.col("abs_r") > threshold).withColumn("reason", F.lit("correlation"))
    named = [c for c in df.columns if c != target and has_word(c, fv.DERIVED_FROM_TARGET_WORDS)]
    by_name = table.where(F.col("column_name").isin(named)).withColumn("reason", F.lit("name"))
    return by_value.unionByName(by_name)


def group_target_stats(df: DataFrame, category: str, target: str) -> DataFrame:
    """(value, n, mean, std) of the target per category."""
    return df.groupBy(col(category).alias("value")).agg(
        F.count(col(target)).alias("n"), F.avg(col(target)).alias("mean"), F.stddev_samp(col(target)).alias("std")
    )


def _groups(df: DataFrame, category: str, target: str) -> DataFrame:
    y = col(target).cast("double")
    return (
        df.where(col(category).isNotNull() & y.isNotNull())
        .groupBy(col(category).alias("value"))
        .agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    )


def eta_squared(df: DataFrame, category: str, target: str) -> DataFrame:
    """(n_groups, eta_squared): share of the target's variance between categories."""
    total = F.sum("n")
    grand = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    share = F.when(between + within > 0, between / (between + within)).otherwise(F.lit(0.0))
    return _groups(df, category, target).agg(F.count("*").alias("n_groups"), share.alias("eta_squared"))


def group_spread(df: DataFrame, category: str, target: str) -> DataFrame:
    """(spread_pct): distance between the extreme group means, in % of the overall mean."""
    overall = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    return _groups(df, category, target).agg(
        ((F.max("m") - F.min("m")) / overall * 100.0).alias("spread_pct"), overall.alias("overall_mean")
    )
