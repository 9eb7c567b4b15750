"""Input forms for scoring: ranges, options, steps, defaults, ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import floor, log10

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, feature_category, kinds, numeric_columns
from .correlation import target_correlation
from .frequencies import most_common_option
from .importance import importance_rank, tiers
from .profiling import coefficient_of_variation, numeric_range_stats
from .quantiles import exact_quantiles

NUMERIC_FORM = ("numeric-continuous", "numeric-discrete")


def input_schema(df: DataFrame, target: str, roles: Mapping[str, str]) -> DataFrame:
    """One row per feature: numeric range, or number of options and first option.

    The options themselves are rows of `frequencies.options`, never one array.
    """
    folded = kinds(df)
    features = [c for c in df.columns if c != target]
    numeric = [c for c in features if folded[c] in ("int", "float") and roles.get(c, NUMERIC_FORM[0]) in NUMERIC_FORM]
    others = [c for c in features if c not in numeric]
    role = lambda names: F.create_map(*[x for c in names for x in (F.lit(c), F.lit(roles.get(c, "unknown")))])
    none = F.lit(None)
    tables = []
    if numeric:
        stats = numeric_range_stats(df, numeric)
        tables.append(stats.where(F.col("min").isNotNull()).select(
            F.col("column_name").alias("feature"), F.lit("numeric").alias("input_type"),
            role(numeric)[F.col("column_name")].alias("role"), "min", "max", "mean", "std",
            none.cast("bigint").alias("n_options"), none.cast("string").alias("default_option"),
        ))
    if others:
        from .frequencies import options

        found = options(df, others).groupBy("column_name").agg(F.count("*").alias("n_options"), F.min("option").alias("default_option"))
        tables.append(found.select(
            F.col("column_name").alias("feature"), F.lit("categorical").alias("input_type"),
            role(others)[F.col("column_name")].alias("role"),
            *[none.cast("double").alias(k) for k in ("min", "max", "mean", "std")], "n_options", "default_option",
        ))
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def half_even(x: float, digits: int = 0) -> float:
    return float(round(x, digits))


def form_step(low: float, high: float) -> float:
    """A hundredth of the range, rounded to its leading digit."""
    step = (high - low) / 100 if high > low else 1.0
    if step < 1:
        return half_even(step, max(0, -floor(log10(step))))
    return max(1.0, half_even(step))


def slider_step(low: float, high: float) -> tuple[float, str]:
    """Step with one more digit than `form_step`, and the number format that shows it."""
    if high <= low:
        return 1.0, ".0f"
    step = (high - low) / 100
    if step < 1:
        places = max(0, -floor(log10(step)) + 1)
        return half_even(step, places), f".{places}f"
    return max(1.0, half_even(step)), ".0f"


def _numeric_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    facts = {r["column_name"]: r.asDict() for r in numeric_range_stats(df, columns).collect()}
    for c, (q25, median, q75) in exact_quantiles(df, columns, (0.25, 0.5, 0.75)).items():
        facts[c] |= {"q25": q25, "median": median, "q75": q75}
    return facts


def enhanced_input_schema(
    df: DataFrame, target: str, roles: Mapping[str, str], importance: DataFrame | None = None
) -> DataFrame:
    """`input_schema` with quartiles, step, suggestion, correlation, rank, category and rule text."""
    features = [c for c in df.columns if c != target]
    folded = kinds(df)
    numeric = [c for c in features if folded[c] in ("int", "float") and roles.get(c, NUMERIC_FORM[0]) in NUMERIC_FORM]
    others = [c for c in features if c not in numeric]
    facts = _numeric_facts(df, numeric)
    r = {x["column_name"]: x["r"] for x in target_correlation(df, target, numeric).collect()} if target in numeric_columns(df) else {}
    ranks = {x["feature"]: (x["rank"], x["score"]) for x in _ranked(importance).collect()} if importance is not None else {}
    common = {x["column_name"]: x for x in most_common_option(df, others).collect()} if others else {}
    rows = []
    for c in features:
        rank, score = ranks.get(c, (None, None))
        if c in facts and facts[c]["min"] is not None:
            f = facts[c]
            step = form_step(f["min"], f["max"])
            rows.append((c, "numeric", feature_category(c), f["min"], f["max"], f["mean"], step, f["median"],
                         ".3f" if step < 1 else ".0f", f["q25"], f["median"], f["q75"], None, None, r.get(c), rank, score,
                         "range"))
        elif c in common:
            m = common[c]
            rows.append((c, "categorical", feature_category(c), None, None, None, None, None, None, None, None, None,
                         m["n_options"], m["default_option"], None, rank, score, "options"))
    schema = (
        "feature string, input_type string, category string, min double, max double, default_value double, step double, "
        "suggested double, display_format string, q25 double, median double, q75 double, n_options bigint, "
        "default_option string, r double, importance_rank int, importance_score double, rule string"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def _ranked(importance: DataFrame) -> DataFrame:
    return importance_rank(importance.select(F.col("feature").alias("column_name"), "score")).withColumnRenamed("column_name", "feature")


def slider_config(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, min, max, default_value, step, suggested, display_format, std, q25, q75)."""
    names = list(columns or numeric_columns(df))
    facts = _numeric_facts(df, names)
    rows = []
    for c in names:
        f = facts[c]
        if f["min"] is None:
            rows.append((c, 0.0, 1.0, 0.0, 0.1, 0.0, ".1f", None, None, None))
            continue
        step, shown = slider_step(f["min"], f["max"])
        rows.append((c, f["min"], f["max"], f["mean"], step, f["median"], shown, f["std"], f["q25"], f["q75"]))
    schema = (
        "feature string, min double, max double, default_value double, step double, suggested double, "
        "display_format string, std double, q25 double, q75 double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def ranked_input_schema(df: DataFrame, target: str | None = None, importance: DataFrame | None = None) -> DataFrame:
    """(feature, score, importance, tier, rank, category, in_focus): features by normalised importance.

    Without attributions the score is the coefficient of variation.
    """
    data = df.select(*[col(c) for c in df.columns if c != target])
    scores = (
        importance.select(F.col("feature").alias("column_name"), "score")
        if importance is not None
        else coefficient_of_variation(data)
    )
    topics = F.create_map(*[x for c in data.columns for x in (F.lit(c), F.lit(feature_category(c)))])
    return tiers(scores).select(
        F.col("column_name").alias("feature"), "score", "importance", "tier", "rank",
        topics[F.col("column_name")].alias("category"), (F.col("rank") <= 10).alias("in_focus"),
    )


def tier_counts(ranked: DataFrame) -> DataFrame:
    """(grouping, key, n): features per tier and per category."""
    return (
        ranked.select(F.stack(F.lit(2), F.lit("tier"), F.col("tier"), F.lit("category"), F.col("category")).alias("grouping", "key"))
        .groupBy("grouping", "key")
        .agg(F.count("*").alias("n"))
    )


