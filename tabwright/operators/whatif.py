"""What-if analysis over every row of a table: scenarios and sweeps.

Scenarios and grids are short literal lists, so rows are multiplied inside
their own partition by `explode`; nothing is cross-joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col


def scenarios(df: DataFrame, changes: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Each row once per named scenario, with that scenario's columns replaced."""
    touched = sorted({c for change in changes.values() for c in change})
    parts = [
        F.struct(F.lit(i).alias("scenario_no"), F.lit(name).alias("scenario"), *[change.get(c, col(c)).cast(df.schema[c].dataType).alias(c) for c in touched])
        for i, (name, change) in enumerate(changes.items())
    ]
    rest = [c for c in df.columns if c not in touched]
    return df.select(*[col(c) for c in rest], F.inline(F.array(*parts)))


def scenario_compare(df: DataFrame, base: Sequence[str], prediction: str, names: Sequence[str]) -> DataFrame:
    """(base, n, std, range, cv, ranking) over the scenarios of each base row; best first.

    One buffer slot per scenario name: nothing is collected, so a base key that
    holds many rows combines map-side like any other.
    """
    p = col(prediction)
    slots = {f"__p{i}": F.max(F.when(F.col("scenario") == name, p)) for i, name in enumerate(names)}
    table = df.groupBy(*[col(b) for b in base]).agg(
        F.count("*").alias("n"),
        F.stddev_pop(p).alias("std"),
        (F.max(p) - F.min(p)).alias("range"),
        F.coalesce(F.stddev_pop(p) / F.nullif(F.avg(p), F.lit(0.0)), F.lit(0.0)).alias("cv"),
        *[e.alias(k) for k, e in slots.items()],
    )
    pairs = F.array(*[F.struct((-F.col(k)).alias("order"), F.lit(name).alias("name")) for k, name in zip(slots, names)])
    ranked = F.array_sort(F.filter(pairs, lambda s: s["order"].isNotNull()))
    ranking = F.array_join(F.transform(ranked, lambda s: s["name"]), ">")
    return table.withColumn("ranking", ranking).drop(*slots)


def scenario_pair_diff(df: DataFrame, base: Sequence[str], inputs: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(base, scenario, differences): inputs that differ from the first scenario of the same base row."""
    given = F.struct(*[col(c) for c in inputs])
    table = df.groupBy(*[col(b) for b in base]).agg(
        *[F.max(F.when(F.col("scenario") == name, given)).alias(f"__s{i}") for i, name in enumerate(names)]
    )

    def differences(i: int) -> Column:
        now, first = F.col(f"__s{i}"), F.col("__s0")
        shown = lambda c: F.concat(F.lit(f"{c}: "), now[c].cast("string"), F.lit(" vs "), first[c].cast("string"))
        return F.concat_ws("; ", *[F.when(~now[c].eqNullSafe(first[c]), shown(c)) for c in inputs])

    rows = [
        F.struct(F.lit(name).alias("scenario"), F.when(F.col(f"__s{i}").isNotNull(), differences(i)).alias("differences"))
        for i, name in enumerate(names) if i
    ]
    return table.select(*[col(b) for b in base], F.inline(F.array(*rows))).where(F.col("differences").isNotNull())


def sweep(df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """Each row once per grid value of one feature, other inputs fixed."""
    values = F.array(*[F.lit(float(g)) for g in grid])
    return df.withColumn("grid_value", F.explode(values)).withColumn(feature, F.col("grid_value").cast(df.schema[feature].dataType))


def sensitivity_sweep(model: PipelineModel, df: DataFrame, keys: Sequence[str], feature: str, grid: Sequence[float]) -> DataFrame:
    """(keys, grid_value, prediction)."""
    return model.transform(sweep(df, feature, grid)).select(*[col(k) for k in keys], "grid_value", "prediction")


def sweep_monotonicity(
    swept: DataFrame, keys: Sequence[str], grid: Sequence[float], prediction: str = "prediction"
) -> DataFrame:
    """(keys, rising_pct, range_pct, r) per base row.

    One buffer slot per grid value; pairs of grid values are compared inside
    the row and never become rows.
    """
    grid = sorted(float(g) for g in grid)
    g, p = F.col("grid_value"), col(prediction)
    points = swept.groupBy(*[col(k) for k in keys]).agg(
        *[F.avg(F.when(g == v, p)).alias(f"__g{i}") for i, v in enumerate(grid)],
        ((F.max(p) - F.min(p)) / F.nullif(F.avg(p), F.lit(0.0)) * 100.0).alias("range_pct"),
        F.when(F.stddev_pop(p) > 0, F.corr(g, p)).alias("r"),
    )
    line = F.array(*[F.col(f"__g{i}") for i in range(len(grid))])
    after = lambda i: F.slice("__line", i + 2, len(grid))
    rises = F.aggregate(
        F.transform(F.col("__line"), lambda x, i: F.size(F.filter(after(i), lambda y: y > x))), F.lit(0), lambda a, x: a + x
    )
    pairs = len(grid) * (len(grid) - 1) // 2
    return points.withColumn("__line", line).select(
        *[col(k) for k in keys], (rises * 100.0 / F.lit(pairs)).alias("rising_pct"), "range_pct", "r"
    )
