"""Attribution: closed form for linear models, permutations or a kernel regression for any other."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, kinds, sigmoid, softmax
from ..functions.sizing import parted

BACKGROUND_ROWS = 10
#: Coalitions of a kernel design; up to 11 features have no more.
MOST_COALITIONS = 2_046


def explain_input_checks(df: DataFrame, target: str, task: str) -> DataFrame:
    """(check, passed, observed)."""
    rows = df.agg(F.count(F.lit(1))).first()[0]
    features = [c for c in df.columns if c != target]
    folded = kinds(df)
    odd = [c for c in features if folded[c] not in ("int", "float", "bool")]
    checks = [
        ("enough_rows", rows >= 2, float(rows)),
        ("enough_features", len(features) >= 1, float(len(features))),
        ("known_task", task in fv.TASKS, None),
        ("all_numeric", not odd, float(len(odd))),
    ]
    return df.sparkSession.createDataFrame(checks, "check string, passed boolean, observed double")


def explain_sample(df: DataFrame, keys: Sequence[str], n: int = fv.EXPLAIN_ROWS, seed: int = 42) -> DataFrame:
    """The n rows with the smallest keyed hash: the same sample in every run."""
    text = F.concat_ws("-", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *[col(k) for k in keys]).limit(n)


def class_probabilities(raw: Column, classes: int = 2) -> Column:
    """Probability array from a margin (two classes) or from a margin per class."""
    if classes == 2:
        return F.array(1 - sigmoid(raw), sigmoid(raw))
    return softmax(raw)


def hard_probabilities(prediction: Column, classes: int) -> Column:
    """0.9 for the predicted class, the rest shared, for models without scores."""
    rest = 0.1 / (classes - 1) if classes > 1 else 0.5
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == prediction, 0.9).otherwise(rest))


def probabilities(predicted: DataFrame, classes: int = 2) -> DataFrame:
    """Add `probabilities`, from the best output the model has."""
    if "probability" in predicted.columns:
        p = vector_to_array(F.col("probability"))
    elif "rawPrediction" in predicted.columns:
        raw = vector_to_array(F.col("rawPrediction"))
        p = class_probabilities(raw[1], 2) if classes == 2 else class_probabilities(raw, classes)
    else:
        p = hard_probabilities(F.col("prediction"), classes)
    return predicted.withColumn("probabilities", p)


def linear_attribution(
    df: DataFrame, keys: Sequence[str], weights: Mapping[str, float], means: Mapping[str, float] | None = None
) -> DataFrame:
    """(keys, feature, phi) with phi = weight * (x - mean): exact for linear models."""
    if means is None:
        row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(weights)]).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(weights)}
    parts = [
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (col(c) - F.lit(float(means[c])))).alias("phi"))
        for c, w in weights.items()
    ]
    return df.select(*[col(k) for k in keys], F.inline(F.array(*parts)))


def shapley_by_permutation(
    model: PipelineModel,
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    output: Column | Sequence[Column] | None = None,
    permutations: int = 4,
    background_rows: int = BACKGROUND_ROWS,
    seed: int = 42,
) -> DataFrame:
    """(keys, feature, phi) for any model; phi is an array when there are several outputs.

    Each row is explained on its own: a feature order switches features one by
    one from a background row to the row's values, and the change of the model
    output goes to the feature switched.  Orders come in mirrored pairs.  Rows
    are exploded by literal arrays, scored by one `transform`, and averaged;
    the phi of a row add up to its output minus the mean background output.
    """
    outputs = [F.col("prediction").cast("double")] if output is None else [output] if isinstance(output, Column) else list(output)
    sample = explain_sample(df, keys, background_rows, seed).select(*[col(c).cast("double").alias(c) for c in features])
    background = [list(r) for r in sample.collect()]
    rng = random.Random(seed)
    orders = []
    for _ in range(permutations):
        order = list(range(len(features)))
        rng.shuffle(order)
        orders += [order, order[::-1]]
    place = [[o.index(j) for j in range(len(features))] for o in orders]
    start = F.array(*[F.array(*[F.lit(v) for v in b]) for b in background])
    where = F.array(*[
        F.struct(F.array(*[F.lit(v) for v in p]).alias("place"), F.array(*[F.lit(v) for v in o]).alias("order")) for p, o in zip(place, orders)
    ])
    steps = F.sequence(F.lit(0), F.lit(len(features)))
    grown = (
        df.select(*[col(k) for k in keys], *[col(c).cast("double").alias(c) for c in features])
        .withColumn("__b", F.explode(start))
        .withColumn("__o", F.explode(where))
        .withColumn("__k", F.explode(steps))
    )
    mixed = grown.select(
        *[col(k) for k in keys], "__o", "__k",
        *[F.when(F.col("__o.place")[j] < F.col("__k"), col(c)).otherwise(F.col("__b")[j]).alias(c) for j, c in enumerate(features)],
    )
    values = [o.alias(f"__v{i}") for i, o in enumerate(outputs)]
    scored = model.transform(mixed).select(*[col(k) for k in keys], "__o", "__k", *values)
    # A step ends the switch of one feature (+) and begins that of the next (-): two parts a row, whatever the width.
    names = [f"__v{i}" for i in range(len(outputs))]
    named = F.array(*[F.lit(c) for c in features])
    share = [
        F.struct(F.get(named, F.get("__o.order", F.col("__k") - 1)).alias("feature"), F.lit(1).alias("sign")),
        F.struct(F.get(named, F.get("__o.order", F.col("__k"))).alias("feature"), F.lit(-1).alias("sign")),
    ]
    n = len(orders) * len(background)
    phi = [F.sum(F.col("sign") * F.col(v)) / F.lit(float(n)) for v in names]
    return (
        scored.select(*[col(k) for k in keys], *names, F.inline(F.array(*share)))
        .where(F.col("feature").isNotNull())
        .groupBy(*[col(k) for k in keys], "feature")
        .agg((phi[0] if len(phi) == 1 else F.array(*phi)).alias("phi"))
    )


def coalitions(features: int, most: int = MOST_COALITIONS, seed: int = 42) -> list[tuple[tuple[bool, ...], float]]:
    """(known features, weight) of a kernel design, without the empty and the full coalition.

    All coalitions when there are at most `most`; else whole sizes from both ends, where the kernel has its
    weight, as long as they fit, and pairs of a drawn coalition and its complement, which share the weight
    of the sizes between.
    """
    def kernel(size: int) -> float:
        return (features - 1) / (math.comb(features, size) * size * (features - size))

    def of_size(size: int):
        for chosen in itertools.combinations(range(features), size):
            yield tuple(j in chosen for j in range(features))

    out: list[tuple[tuple[bool, ...], float]] = []
    sizes = list(range(1, features))
    while sizes:
        ends = {sizes[0], sizes[-1]}
        if len(out) + sum(math.comb(features, size) for size in ends) > most:
            break
        out += [(mask, kernel(size)) for size in sorted(ends) for mask in of_size(size)]
        sizes = [size for size in sizes if size not in ends]
    if sizes:
        rng = random.Random(seed)
        mass = [kernel(size) * math.comb(features, size) for size in sizes]
        drawn: Counter = Counter()
        for _ in range(max(1, (most - len(out)) // 2)):
            size = rng.choices(sizes, mass)[0]
            chosen = set(rng.sample(range(features), size))
            mask = tuple(j in chosen for j in range(features))
            drawn[mask] += 1
            drawn[tuple(not known for known in mask)] += 1
        out += [(mask, sum(mass) * n / drawn.total()) for mask, n in drawn.items()]
    return out


def kernel_solution(design: Sequence[tuple[tuple[bool, ...], float]]) -> np.ndarray:
    """Row j: what each coalition's value, then the empty and the full one's, count for feature j.

    Least squares of the values on the known features, weighted, with the sum of all attributions held to
    full less empty.  The normal equations hold the design only, so one solution serves every row.
    """
    z = np.array([mask for mask, _ in design], float)
    w = np.array([weight for _, weight in design])
    m = z.shape[1]
    normal = np.zeros((m + 1, m + 1))
    normal[:m, :m] = z.T @ (w[:, None] * z)
    normal[:m, m] = normal[m, :m] = 1
    right = np.zeros((m + 1, len(w) + 2))
    right[:m, :-2] = z.T * w
    right[:m, -2] = -(z.T @ w)  # values are taken less the empty coalition's
    right[m, -2:] = -1, 1
    return np.linalg.solve(normal, right)[:m]


def kernel_attribution(
    model: Transformer, df: DataFrame, keys: Sequence[str], features: Sequence[str], output: Column | None = None,
    background: Sequence[Sequence[float]] | None = None, background_rows: int = BACKGROUND_ROWS, most: int = MOST_COALITIONS, seed: int = 42,
    is_parted: bool = False,
) -> DataFrame:
    """(keys, feature, phi) for any model by kernel-weighted least squares: exact when all coalitions fit into `most`.

    A coalition's value is the model's mean output with the known features from the row and the others
    from each background row.  Rows are exploded by literal arrays, scored by one `transform` and summed
    with the solution's weights: one partial row a key, whatever the number of coalitions.  Rows that share
    all keys are explained together.  Rows are hashed by key into tasks of bounded size before they are
    exploded, unless `is_parted` says that they are (`parted`), so nothing exploded is shuffled.
    """
    if not is_parted:
        df = parted(df, keys, df.count())
    if background is None:
        sample = explain_sample(df, keys, background_rows, seed).select(*[col(c).cast("double").alias(c) for c in features])
        background = [list(r) for r in sample.collect()]
    m = len(features)
    design = coalitions(m, most, seed) if m > 1 else []
    masks = [*[mask for mask, _ in design], (False,) * m, (True,) * m]
    solution = kernel_solution(design) if m > 1 else np.array([[-1.0, 1.0]])
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(v) for v in mask]).alias("known")) for i, mask in enumerate(masks)])
    grown = (
        df.select(*[col(k) for k in keys], *[col(c).cast("double").alias(c) for c in features])
        .withColumn("__b", F.explode(F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in background])))
        .withColumn("__s", F.explode(known))
    )
    mixed = grown.select(
        *[col(k) for k in keys], F.col("__s.i").alias("__i"),
        *[F.when(F.col("__s.known")[j], col(c)).otherwise(F.col("__b")[j]).alias(c) for j, c in enumerate(features)],
    )
    value = F.col("prediction").cast("double") if output is None else output
    scored = model.transform(mixed).select(*[col(k) for k in keys], "__i", value.alias("__v"))
    counts = [F.array(*[F.lit(float(v)) for v in line]) for line in solution]
    full = F.count_if(F.col("__i") == len(masks) - 1)  # background rows x rows of the key
    sums = scored.groupBy(*[col(k) for k in keys]).agg(
        full.alias("__n"), *[F.sum(F.get(c, F.col("__i")) * F.col("__v")).alias(f"__p{j}") for j, c in enumerate(counts)]
    )
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"__p{j}") / F.col("__n")).alias("phi")) for j, c in enumerate(features)])
    return sums.select(*[col(k) for k in keys], F.inline(parts))


def class_outputs(model: PipelineModel, classes: int) -> Column | list[Column]:
    """What is explained of a classifier: the positive class of two, else every class."""
    last = model.stages[-1]
    while isinstance(last, PipelineModel):
        last = last.stages[-1]
    if hasattr(last, "getProbabilityCol"):
        p = vector_to_array(F.col(last.getProbabilityCol()))
        return p[1] if classes == 2 else [p[k] for k in range(classes)]
    raw = vector_to_array(F.col(last.getRawPredictionCol()))
    return class_probabilities(raw[1])[1] if classes == 2 else [raw[k] for k in range(classes)]


def global_importance(phi: DataFrame, value: str = "phi") -> DataFrame:
    """(feature, score): mean |phi|; an array of per-class phi is averaged over classes first."""
    x = F.col(value)
    if dict(phi.dtypes)[value].startswith("array"):
        strength = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(x)
    else:
        strength = F.abs(x)
    return phi.groupBy("feature").agg(F.avg(strength).alias("score"))


def grouped_importance(model: PipelineModel, scored: DataFrame) -> DataFrame | None:
    """`model_importance` by column of the assembled features: a vector column has the sum of its places."""
    assembled = next(s for s in model.stages if isinstance(s, VectorAssembler))
    kept = dict(scored.dtypes)
    row = scored.select(*[col(c) for c in assembled.getInputCols()]).first()
    names = [c for c in assembled.getInputCols() for _ in range(row[c].size if kept[c] == "vector" else 1)]
    each = model_importance(model, names)
    return None if each is None else each.groupBy("feature").agg(F.sum("score").alias("score"))


def model_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame | None:
    """(feature, score) from tree importances or |coefficients|, None if there are none."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        return None
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, score double")
