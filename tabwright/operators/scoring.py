"""Scoring tables: alignment, predictions, intervals, contributions, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, count_where, kinds, safe_number


def column_set_diff(df: DataFrame, expected: Sequence[str], target: str | None = None) -> list[str]:
    """What differs between the columns given and the columns expected."""
    issues = []
    if target is not None and target in df.columns:
        issues.append(f"target column {target} is among the inputs")
    extra = [c for c in df.columns if c not in expected]
    absent = [c for c in expected if c not in df.columns]
    issues += [f"unexpected columns: {extra}"] * bool(extra) + [f"missing columns: {absent}"] * bool(absent)
    if len(df.columns) != len(expected):
        issues.append(f"{len(df.columns)} columns instead of {len(expected)}")
    return issues


def _as_number(folded: Mapping[str, str], c: str):
    return safe_number(col(c)) if folded[c] == "str" else col(c).cast("double")


def feature_align(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected numeric columns, in order: extras dropped, gaps and bad values 0."""
    folded = kinds(df)
    out = [
        F.coalesce(_as_number(folded, c), F.lit(0.0)).alias(c) if c in folded else F.lit(0.0).alias(c) for c in expected
    ]
    return df.select(*[col(k) for k in keep], *out)


def batch_error_rows(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Add `error`: which expected inputs of a row are not numbers; NULL when all are."""
    folded = kinds(df)
    bad = [
        F.when(col(c).isNotNull() & _as_number(folded, c).isNull(), F.lit(f"{c} is not a number"))
        if c in folded else F.lit(f"{c} is missing")
        for c in expected
    ]
    text = F.concat_ws("; ", *bad)
    return df.withColumn("error", F.when(text != "", text))


def batch_predict(model: PipelineModel, df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Aligned features and `prediction` for every row."""
    if not df.columns or not expected:
        raise ValueError("nothing to score: no columns")
    scored = model.transform(feature_align(df, expected, keep))
    return scored.select(*[col(k) for k in keep], *[col(c) for c in expected], "prediction")


def with_probabilities(model: PipelineModel, df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add `probabilities` (class -> probability), `predicted_class` and `confidence`."""
    scored = model.transform(df)
    p = vector_to_array(F.col("probability"))
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_max(p)
    return (
        scored.withColumn("probabilities", F.map_from_arrays(names, p))
        .withColumn("predicted_class", F.element_at(names, F.array_position(p, best).cast("int")))
        .withColumn("confidence", best)
    )


def prediction_summary(df: DataFrame, prediction: str, task: str) -> DataFrame:
    """Regression: n, missing, min, max, mean, sample std.  Classification: n per class."""
    p = col(prediction)
    if task == "classification":
        return df.groupBy(p.cast("string").alias("prediction_class")).agg(F.count("*").alias("n"))
    return df.agg(
        F.count(F.lit(1)).alias("n"), count_where(p.isNull()).alias("missing"),
        F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"),
    )


def batch_summary(df: DataFrame, prediction: str) -> DataFrame:
    """(total, successful, failed, min, max, mean, std) with the population std."""
    p = col(prediction)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count(p).alias("successful"), count_where(p.isNull()).alias("failed"),
        F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"),
    )


def prediction_interval(df: DataFrame, prediction: str, level: float = 0.95) -> DataFrame:
    """Add lower_bound, upper_bound and std_error = 0.1 |prediction|."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    p = col(prediction)
    error = F.abs(p) * F.lit(fv.INTERVAL_SHARE)
    return df.withColumns({
        "lower_bound": p - F.lit(z) * error,
        "upper_bound": p + F.lit(z) * error,
        "confidence_level": F.lit(level),
        "std_error": error,
    })


def feature_contributions(df: DataFrame, keys: Sequence[str], importance: Mapping[str, float]) -> DataFrame:
    """(keys, feature, feature_value, contribution, direction) with contribution = importance * value."""
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            col(c).cast("double").alias("feature_value"),
            F.coalesce(F.lit(float(w)) * col(c).cast("double"), F.lit(0.0)).alias("contribution"),
        )
        for c, w in importance.items()
    ]
    direction = F.when(F.col("contribution") > 0, "positive").when(F.col("contribution") < 0, "negative").otherwise("neutral")
    return df.select(*[col(k) for k in keys], F.inline(F.array(*parts))).withColumn("direction", direction)


def top_contributions(df: DataFrame, keys: Sequence[str], importance: Mapping[str, float], n: int = 5) -> DataFrame:
    """The n largest |contributions| of every row, ranked inside the row (no shuffle)."""
    parts = [
        F.struct(
            (-F.abs(F.coalesce(F.lit(float(w)) * col(c).cast("double"), F.lit(0.0)))).alias("order"),
            F.lit(c).alias("feature"),
            F.coalesce(F.lit(float(w)) * col(c).cast("double"), F.lit(0.0)).alias("contribution"),
        )
        for c, w in importance.items()
    ]
    ranked = F.slice(F.array_sort(F.array(*parts)), 1, n)
    return df.select(*[col(k) for k in keys], F.posexplode(ranked).alias("at", "c")).select(
        *[col(k) for k in keys], (F.col("at") + 1).alias("rank"), "c.feature", "c.contribution"
    )


def enhanced_prediction(
    scored: DataFrame, keys: Sequence[str], inputs: Sequence[str], importance: Mapping[str, float], task: str
) -> DataFrame:
    """Prediction with interval or probabilities, top five features and inputs in one row."""
    parts = [
        F.struct((-F.abs(F.coalesce(F.lit(float(w)) * col(c).cast("double"), F.lit(0.0)))).alias("order"), F.lit(c).alias("feature"))
        for c, w in importance.items()
    ]
    top = F.transform(F.slice(F.array_sort(F.array(*parts)), 1, 5), lambda s: s["feature"])
    given = F.to_json(F.struct(*[col(c) for c in inputs]))
    base = prediction_interval(scored, "prediction") if task == "regression" else scored
    extra = ["lower_bound", "upper_bound"] if task == "regression" else ["predicted_class", "confidence"]
    return base.select(
        *[col(k) for k in keys], "prediction", *extra,
        F.array_join(top, ",").alias("top_features"), given.alias("input_features"),
    )


def prediction_variation(df: DataFrame, prediction: str, least: float = 0.15) -> DataFrame:
    """(mean, std, cv, varies): does the model do more than predict the mean?"""
    p = col(prediction)
    cv = F.stddev_pop(p) / F.nullif(F.avg(p), F.lit(0.0))
    return df.agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), cv.alias("cv"), (cv >= least).alias("varies"))


def target_scale_check(df: DataFrame, target: str, low: float, high: float) -> DataFrame:
    """(mean, min, max, in_range): is the target on the expected scale?"""
    y = col(target)
    return df.agg(F.avg(y).alias("mean"), F.min(y).alias("min"), F.max(y).alias("max")).withColumn(
        "in_range", F.col("mean").between(low, high)
    )


def input_range_check(
    df: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple[float, float]], allowed: Mapping[str, Sequence[str]]
) -> DataFrame:
    """(keys, violations): inputs outside their range or options, joined by commas; clean rows are left out."""
    flags = [F.when(~col(c).between(a, b), F.lit(c)) for c, (a, b) in ranges.items()]
    flags += [F.when(~col(c).cast("string").isin(list(v)), F.lit(c)) for c, v in allowed.items()]
    found = F.concat_ws(",", *flags)
    return df.select(*[col(k) for k in keys], found.alias("violations")).where(F.col("violations") != "")


