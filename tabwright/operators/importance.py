"""Feature scores before training: F statistic, mutual information, |r|.

Text features are label-encoded for scoring.  The code of a value is its
position among the sorted distinct values, so sums over rows equal sums over
(value, count, sum of target) groups: text is scored from the grouped table and
no code is ever joined back to the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, kinds, safe_number
from ..functions.sizing import DRIVER_ROWS, numbered, rows_if_bounded
from .frequencies import modes, value_frequencies
from .profiling import per_column
from .quantiles import exact_quantiles
from .roles import Target

MI_BINS = 8


def numeric_text(df: DataFrame, columns: Sequence[str] | None = None, share: float = fv.MIN_NUMERIC_SHARE) -> DataFrame:
    """(column_name, parsed_share, is_numeric): text whose values mostly parse as numbers."""
    folded = kinds(df)
    names = [c for c in (columns or df.columns) if folded[c] == "str"]
    parsed = lambda c: F.count(safe_number(col(c))) / F.count(F.lit(1))
    table = per_column(df, names, {"parsed_share": parsed})
    return table.withColumn("is_numeric", F.col("parsed_share") >= share)


def numbered_values(values: DataFrame, name: str) -> DataFrame:
    """0-based position of each distinct text value in sorted order.

    Few values are numbered in one small window, many by range partitions.
    """
    key = values.columns[0]
    if rows_if_bounded(values.select(key), DRIVER_ROWS) is None:
        return numbered(values, [key], name)
    return values.withColumn(name, F.row_number().over(Window.orderBy(key)) - 1)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, n, code) of a text column, codes in sorted order."""
    values = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    return numbered_values(values, "code").withColumn("code", F.col("code").cast("int"))


def stable_fills(df: DataFrame, target: str) -> dict[str, object]:
    """Fill values of the temporary clean-up: medians, the target's mode or median."""
    folded = kinds(df)
    fills: dict[str, object] = {}
    parsed = {}
    texts = [c for c in df.columns if c != target and folded[c] == "str"]
    if texts:
        parsed = {r["column_name"]: r["is_numeric"] for r in numeric_text(df, texts).collect()}
    medians = [c for c in df.columns if folded[c] in ("int", "float") and (c != target or folded[c] == "float")]
    as_number = df.select(
        *[col(c) for c in medians], *[safe_number(col(c)).alias(c) for c in texts if parsed[c]]
    )
    if as_number.columns:
        # Only columns with holes need their median.
        row = as_number.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(as_number.columns)]).first()
        holes = [c for i, c in enumerate(as_number.columns) if row[f"c{i}"] < row["n"]]
        for c, (m,) in (exact_quantiles(as_number, holes, (0.5,)) if holes else {}).items():
            fills[c] = 0.0 if m is None else m
        for c in as_number.columns:
            fills.setdefault(c, 0.0)
    for c in texts:
        fills.setdefault(c, fv.MISSING_TEXT)
    if folded[target] == "str":
        fills[target] = fv.MISSING_TARGET
    elif folded[target] == "int":
        top = modes(value_frequencies(df, [target])).first()
        fills[target] = top["l"] if top else 0
    return fills


def stable_clean(df: DataFrame, target: str, fills: dict[str, object] | None = None) -> DataFrame:
    """The table made safe for scoring; nothing is dropped, text stays text."""
    folded = kinds(df)
    fills = fills if fills is not None else stable_fills(df, target)
    out = []
    for c in df.columns:
        x = col(c)
        if folded[c] == "bool":
            out.append(F.coalesce(x.cast("int"), F.lit(0)).alias(c))
        elif c in fills and folded[c] == "str" and not isinstance(fills[c], str):
            out.append(F.coalesce(safe_number(x), F.lit(fills[c])).alias(c))
        elif c in fills:
            out.append(F.coalesce(x.cast("double") if isinstance(fills[c], float) else x, F.lit(fills[c])).alias(c))
        elif folded[c] in ("datetime", "other"):
            out.append(F.coalesce(x.cast("string"), F.lit(fv.MISSING_TEXT)).alias(c))
        else:
            out.append(x.alias(c))
    return df.select(*out)


def _coded_target(clean: DataFrame, target: Target) -> DataFrame:
    """Replace a text target by its codes; the label set of a target is small."""
    if kinds(clean)[target.name] != "str":
        return clean
    from ..functions.sizing import lookup

    codes = label_codes(clean, target.name)
    side = codes.select(F.col("value").alias(target.name), F.col("code").alias("__y"), "n")
    joined = lookup(clean, side, target.name, weight="n")
    return joined.select(*[col(c) if c != target.name else F.col("__y").alias(c) for c in clean.columns])


def correlation_with_codes(clean: DataFrame, target: str) -> DataFrame:
    """(column_name, n, r): Pearson r with the target, text columns by their codes."""
    folded = kinds(clean)
    y = col(target).cast("double")
    numeric = [c for c in clean.columns if c != target and folded[c] in ("int", "float")]
    texts = [c for c in clean.columns if c != target and folded[c] == "str"]
    tables = []
    if numeric:
        tables.append(
            per_column(clean, numeric, {"n": lambda c: F.count(F.lit(1)), "r": lambda c: F.corr(col(c).cast("double"), y)})
        )
    if texts:
        # The target is centred first so that sums of squares stay well scaled.
        mean = clean.agg(F.avg(y)).first()[0]
        parts = [x for c in texts for x in (F.lit(c), col(c))]
        groups = (
            clean.select((y - F.lit(mean)).alias("y"), F.stack(F.lit(len(texts)), *parts).alias("column_name", "value"))
            .groupBy("column_name", "value")
            .agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
        )
        coded = _codes_per_column(groups)
        x, n = F.col("code").cast("double"), F.col("n")
        rows, sx, sy = F.sum(n), F.sum(n * x), F.sum("sy")
        covariance = F.sum(x * F.col("sy")) - sx * sy / rows
        spread = (F.sum(n * x * x) - sx * sx / rows) * (F.sum("syy") - sy * sy / rows)
        tables.append(
            coded.groupBy("column_name").agg(
                rows.alias("n"), F.when(spread > 0, covariance / F.sqrt(spread)).alias("r")
            )
        )
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


def _codes_per_column(groups: DataFrame) -> DataFrame:
    """Number the distinct values inside each column, in sorted order."""
    if rows_if_bounded(groups.select("column_name"), DRIVER_ROWS) is not None:
        return groups.withColumn("code", F.row_number().over(Window.partitionBy("column_name").orderBy("value")) - 1)
    placed = numbered(groups, ["column_name", "value"], "__at")
    first = placed.groupBy("column_name").agg(F.min("__at").alias("__first"))
    return placed.join(F.broadcast(first), "column_name").withColumn("code", F.col("__at") - F.col("__first"))


def f_regression_scores(df: DataFrame, target: str) -> DataFrame:
    """(column_name, f_score): F = r^2 / (1 - r^2) * (n - 2); constants score 0."""
    table = correlation_with_codes(stable_clean(df, target), target)
    r2 = F.col("r") * F.col("r")
    score = r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2)
    perfect = F.when(r2 >= 1, F.lit(float("inf")))
    return table.select("column_name", F.coalesce(perfect, F.nanvl(score, F.lit(0.0)), F.lit(0.0)).alias("f_score"))


def binned(df: DataFrame, columns: Sequence[str], bins: int = MI_BINS) -> dict[str, Column]:
    """Bin number of each numeric column by its exact quantiles."""
    probs = [k / bins for k in range(1, bins)]
    edges = exact_quantiles(df, columns, probs)
    out = {}
    for c in columns:
        number = F.lit(0)
        for e in dict.fromkeys(edges[c]):
            if e is not None:
                number = number + (col(c).cast("double") >= F.lit(float(e))).cast("int")
        out[c] = number
    return out


def mutual_info_scores(df: DataFrame, target: Target, bins: int = MI_BINS) -> DataFrame:
    """(column_name, mi) in nats between each feature and the class.

    Plug-in estimate less its bias (values - 1)(classes - 1) / 2N: numeric
    features in quantile bins, text by value.  A column of unique values, whose
    plug-in estimate is the entropy of the class, so scores about 0.  The estimate
    without bins is `neighbours.neighbour_mutual_info`, at the cost of two sorts.
    """
    clean = stable_clean(df, target.name)
    folded = kinds(clean)
    features = [c for c in clean.columns if c != target.name]
    numeric = [c for c in features if folded[c] in ("int", "float")]
    bin_of = binned(clean, numeric, bins) if numeric else {}
    parts = [
        x for c in features for x in (F.lit(c), bin_of[c].cast("string") if c in bin_of else col(c).cast("string"))
    ]
    joint = (
        clean.select(col(target.name).cast("string").alias("y"), F.stack(F.lit(len(features)), *parts).alias("column_name", "x"))
        .groupBy("column_name", "x", "y")
        .agg(F.count("*").alias("n"))
    )
    by_x = joint.groupBy("column_name", "x").agg(F.sum(F.col("n") * F.log("n")).alias("within"), F.sum("n").alias("nx"))
    by_y = joint.groupBy("column_name", "y").agg(F.sum("n").alias("ny"))
    # MI = (sum n log n - sum nx log nx - sum ny log ny) / N + log N, each sum grouped on its own.
    x_part = by_x.groupBy("column_name").agg((F.sum("within") - F.sum(F.col("nx") * F.log("nx"))).alias("a"), F.count("*").alias("kx"), F.sum("nx").alias("total"))
    y_part = by_y.groupBy("column_name").agg(F.sum(F.col("ny") * F.log("ny")).alias("b"), F.count("*").alias("ky"))
    total = F.col("total").cast("double")
    bias = (F.col("kx") - 1) * (F.col("ky") - 1) / (2 * total)
    mi = (F.col("a") - F.col("b")) / total + F.log(total) - bias
    return x_part.join(F.broadcast(y_part), "column_name").select(  # one row per column
        "column_name", F.greatest(mi, F.lit(0.0)).alias("mi")
    )


def correlation_fallback(df: DataFrame, target: str) -> DataFrame:
    """(column_name, score): |r| for numbers, 0 when undefined, 0.1 for anything else."""
    clean = stable_clean(df, target)
    folded = kinds(clean)
    features = [c for c in clean.columns if c != target]
    y = col(target).cast("double")

    def score(c: str) -> Column:
        if folded[c] not in ("int", "float"):
            return F.max(F.lit(0.1))
        return F.coalesce(F.nanvl(F.abs(F.corr(col(c).cast("double"), y)), F.lit(0.0)), F.lit(0.0))

    return per_column(clean, features, {"score": score})


def feature_scores(
    df: DataFrame, target: Target, information: Callable[[DataFrame, Target], DataFrame] = mutual_info_scores
) -> DataFrame:
    """(column_name, score) by the scorer that fits the task; `information` scores features of a class."""
    if target.task == "classification":
        return information(df, target).withColumnRenamed("mi", "score")
    return f_regression_scores(df, target.name).withColumnRenamed("f_score", "score")


def top_features(scores: DataFrame, n: int = 5) -> DataFrame:
    """The n best-scored features, ties by name."""
    return scores.orderBy(F.desc("score"), "column_name").limit(n)


def key_features(
    df: DataFrame, target: Target, n: int = 5, information: Callable[[DataFrame, Target], DataFrame] = mutual_info_scores
) -> list[str]:
    """The n best features by the scorer of the task; by |r| when that fails, the first n columns when all fails."""
    features = [c for c in df.columns if c != target.name]
    if not features:
        return []
    n = min(n, len(features))
    for scores in (lambda: feature_scores(df, target, information), lambda: correlation_fallback(df, target.name)):
        try:
            return [r["column_name"] for r in top_features(scores(), n).collect()]
        except Exception as problem:  # any failure of a scorer leaves the next way
            warnings.warn(f"features are chosen another way: {type(problem).__name__}: {str(problem)[:200]}", stacklevel=2)
    return features[:n]


def importance_rank(scores: DataFrame) -> DataFrame:
    """Add `rank` by descending score; the table has one row per feature."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "column_name")))


def tiers(scores: DataFrame) -> DataFrame:
    """Add normalised score (score / max), tier and rank."""
    top = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peak = F.max("score").over(top)
    normal = F.when(peak > 0, F.col("score") / peak).otherwise(F.col("score"))
    table = scores.withColumn("importance", normal)
    tier = F.when(F.col("importance") >= fv.TIER_HIGH, "high").when(F.col("importance") >= fv.TIER_MEDIUM, "medium")
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "column_name"))
    return table.withColumn("tier", tier.otherwise("low")).withColumn("rank", rank)


