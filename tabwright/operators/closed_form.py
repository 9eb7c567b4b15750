"""Models with a closed form, for all folds from one scan.

`fold_sums` adds up, for each fold (and class), the number of rows, the sums and the products of all pairs
of columns: one matrix a fold, made by matrix products inside the tasks and summed row by row in Spark, or
by one aggregate a pair when columns are few.
The training part of a fold is the total less that fold.  From such a matrix follow least squares, ridge,
lasso and elastic net (coordinate descent on the matrix), Gaussian naive Bayes and the linear and
quadratic discriminants; rows are read once more to score every model on its held-out fold.

Columns are centred and scaled by their overall mean and deviation first, so that sums of squares lose no
digits.  What reaches the driver has folds x classes x (columns + 1) squared numbers, whatever the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_COLUMNS = 4_000
FEW_COLUMNS = 8  # up to so many, sums and predictions are expressions
SMOOTHING = 1e-9
STEPS, TOLERANCE = 100_000, 1e-14
SCORED_CELLS = 1_000_000


@dataclass
class Sums:
    """(fold, class) -> matrix of sums of products of (1, column, column, ...), columns centred and scaled."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    folds: int
    classes: int
    parts: dict[tuple[int, int], np.ndarray]

    def part(self, fold: int | None, label: int | None = None) -> np.ndarray:
        """The rows outside a fold (all for None), of one class or all."""
        zero = np.zeros((len(self.columns) + 1,) * 2)
        return sum((m for (f, k), m in self.parts.items() if f != fold and label in (None, k)), zero)


def overall(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each array position of `x`; 1 for a constant one."""
    n = len(columns)
    row = df.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    values = np.array([np.nan if v is None else v for v in row], float)
    return values[:n], np.where(values[n:] == 0, 1.0, values[n:])


def fold_sums(df: DataFrame, columns: Sequence[str], folds: int, classes: int = 0) -> Sums:
    """df: fold int, label int (0 without classes), x array<double> of `columns`."""
    columns = list(columns)
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    mean, scale = overall(df, columns)
    n = len(columns)
    if n <= FEW_COLUMNS:
        return Sums(columns, mean, scale, folds, classes, _few_sums(df, mean, scale))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
            fold, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "label"))
            for f, k in np.unique(np.stack([fold, label]), axis=1).T.tolist():
                own = z[(fold == f) & (label == k)]
                total[f, k] = total.get((f, k), 0) + own.T @ own
        for (f, k), m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * (n + 1), pa.int32()), pa.array([k] * (n + 1), pa.int32()), pa.array(range(n + 1), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))],
                names=["fold", "label", "line", "m"],
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for f, k, i, m in zip(*[b.column(c).to_pylist() for c in ("fold", "label", "line", "m")]):
                total[f, k, i] = total.get((f, k, i), 0) + np.array(m)
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([key[j] for key in keys], pa.int32()) for j in range(3)], pa.array([total[key].tolist() for key in keys], pa.list_(pa.float64()))],
                names=["fold", "label", "line", "m"],
            )

    schema = "fold int, label int, line int, m array<double>"
    lines = df.select("fold", "label", "x").mapInArrow(products, schema).repartition("fold", "label", "line").mapInArrow(added, schema)
    parts: dict[tuple[int, int], np.ndarray] = {}
    for r in lines.collect():
        parts.setdefault((r["fold"], r["label"]), np.zeros((n + 1, n + 1)))[r["line"]] = r["m"]
    return Sums(columns, mean, scale, folds, classes, parts)


def _few_sums(df: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The matrices of `fold_sums` of few columns: one aggregate for each pair, without Python."""
    hole = F.lit(float("nan"))
    z = [F.lit(1.0), *[(F.coalesce(F.col("x")[i].cast("double"), hole) - float(m)) / float(s) for i, (m, s) in enumerate(zip(mean, scale))]]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    parts: dict[tuple[int, int], np.ndarray] = {}
    for r in df.groupBy("fold", "label").agg(*[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect():  # folds x classes rows
        m = parts[r["fold"], r["label"]] = np.zeros((len(z), len(z)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
    return parts


# -- linear regression ---------------------------------------------------------


def linear_weights(m: np.ndarray, sums: Sums, penalty: float = 0.0, l1_share: float = 0.0) -> tuple[float, np.ndarray]:
    """(intercept, weights) of the last column on the others, from a matrix of sums.

    The penalty is that of `pyspark.ml`: columns and target in units of their deviation, the penalty in
    units of the target's.
    """
    if not np.isfinite(m).all():
        raise ValueError("a column holds nulls")
    n = m[0, 0]
    centre = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(centre, centre)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    live = np.flatnonzero(std[:-1] > 0)
    weights = np.zeros(len(std) - 1)
    if std[-1] > 0 and len(live):
        unit = np.outer(std, std)
        a, b = cov[np.ix_(live, live)] / unit[np.ix_(live, live)], cov[live, -1] / unit[live, -1]
        strength = penalty / (std[-1] * sums.scale[-1])
        l1, l2 = strength * l1_share, strength * (1 - l1_share)
        a = a + l2 * np.eye(len(live))
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        if l1:
            beta = descended(a, b, l1, beta)
        weights[live] = beta * std[-1] / std[live]
    plain = weights * sums.scale[-1] / sums.scale[:-1]
    middle = sums.mean + centre * sums.scale
    return float(middle[-1] - plain @ middle[:-1]), plain


def descended(a: np.ndarray, b: np.ndarray, l1: float, beta: np.ndarray) -> np.ndarray:
    """The least of x'ax / 2 - b'x + l1 |x| by coordinate descent."""
    beta = beta.copy()
    for _ in range(STEPS):
        most = 0.0
        for j in range(len(b)):
            rest = b[j] - a[j] @ beta + a[j, j] * beta[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0) / a[j, j]
            most, beta[j] = max(most, abs(new - beta[j])), new
        if most < TOLERANCE:
            break
    return beta


# -- class models ---------------------------------------------------------------


def class_terms(kind: str, sums: Sums, fold: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of each class as constant + linear . z + z' square z over centred, scaled columns z.

    naive_bayes: own mean and variance (population, smoothed) for each class and column; linear: one
    covariance of all classes (divisor rows less classes); quadratic: one for each class (rows less 1).
    """
    parts = [sums.part(fold, k) for k in range(sums.classes)]
    if not all(np.isfinite(p).all() for p in parts):
        raise ValueError("a column holds nulls")
    count = np.array([p[0, 0] for p in parts])
    if (count < 2).any():
        raise ValueError("a class has too few rows")
    mean = np.array([p[0, 1:] / p[0, 0] for p in parts])
    scatter = np.array([p[1:, 1:] - p[0, 0] * np.outer(m, m) for p, m in zip(parts, mean)])
    log_prior = np.log(count / count.sum())
    if kind == "naive_bayes":
        whole = sum(parts)
        spread = np.diag(whole)[1:] / whole[0, 0] - (whole[0, 1:] / whole[0, 0]) ** 2
        least = SMOOTHING * (spread * sums.scale**2).max() / sums.scale**2
        inverse = np.array([np.diag(1 / (np.diag(s) / n + least)) for s, n in zip(scatter, count)])
        log_det = np.array([-np.log(np.diag(v)).sum() for v in inverse])
    elif kind == "linear":
        shared = np.linalg.inv(scatter.sum(0) / (count.sum() - len(count)))
        inverse, log_det = np.array([shared] * len(count)), np.zeros(len(count))
    else:
        cov = scatter / (count - 1)[:, None, None]
        if np.linalg.cond(cov).max() > 1e12:
            raise ValueError("the columns of a class depend on each other")
        inverse, log_det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    linear = np.einsum("kij,kj->ki", inverse, mean)
    constant = log_prior - 0.5 * log_det - 0.5 * np.einsum("ki,ki->k", linear, mean)
    square = np.zeros_like(inverse) if kind == "linear" else -0.5 * inverse
    return constant, linear, square


def in_plain_units(terms: tuple[np.ndarray, np.ndarray, np.ndarray], sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same scores over the columns as they are."""
    constant, linear, square = terms
    square = square / np.outer(sums.scale, sums.scale)
    linear = linear / sums.scale
    shift = np.einsum("kij,j->ki", square, sums.mean)
    return constant - linear @ sums.mean + shift @ sums.mean, linear - 2 * shift, square


def expanded(linear: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Weights in the order of PolynomialExpansion(degree=2): x, xx, y, xy, yy, ..."""
    out = []
    for j in range(linear.shape[1]):
        out.append(linear[:, j])
        out += [square[:, i, j] * (2 if i < j else 1) for i in range(j + 1)]
    return np.array(out).T


class Discriminant(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    """Linear or quadratic discriminant over labels 0, 1, ...; the fitted model is plain `pyspark.ml`.

    Class scores of both are linear in the columns or in their products of two, so posterior
    probabilities are those of a multinomial logistic model with these weights.
    """

    quadratic = Param(Params._dummy(), "quadratic", "one covariance for each class", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, quadratic: bool = False):
        super().__init__()
        self._setDefault(quadratic=False)
        self._set(quadratic=quadratic)

    def setLabelCol(self, value: str) -> Discriminant:
        return self._set(labelCol=value)

    def setFeaturesCol(self, value: str) -> Discriminant:
        return self._set(featuresCol=value)

    def _fit(self, df: DataFrame):
        label, features = self.getLabelCol(), self.getFeaturesCol()
        rows = df.select(F.lit(0).alias("fold"), F.col(label).cast("int").alias("label"), vector_to_array(F.col(features)).alias("x"))
        shape = rows.agg(F.max("label").alias("k"), F.max(F.size("x")).alias("n")).first()
        sums = fold_sums(rows, [str(i) for i in range(shape["n"])], 1, shape["k"] + 1)
        quadratic = self.getOrDefault("quadratic")
        constant, linear, square = in_plain_units(class_terms("quadratic" if quadratic else "linear", sums), sums)
        if not quadratic:
            return logistic_model(df.sparkSession, linear, constant, features, self)
        products = f"{features}_products"
        model = logistic_model(df.sparkSession, expanded(linear, square), constant, products, self)
        return PipelineModel([PolynomialExpansion(degree=2, inputCol=features, outputCol=products), model])


def logistic_model(spark: SparkSession, weights: np.ndarray, constant: np.ndarray, features: str, like: Estimator) -> C.LogisticRegressionModel:
    """A multinomial logistic model with given weights."""
    from pyspark.ml.common import _py2java

    sc = spark.sparkContext
    matrix = DenseMatrix(weights.shape[0], weights.shape[1], weights.ravel().tolist(), True)
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"discriminant_{like.uid}", _py2java(sc, matrix), _py2java(sc, Vectors.dense(constant)), len(constant), True
    )
    made.set("featuresCol", features)
    made.set("labelCol", like.getLabelCol())
    return C.LogisticRegressionModel(made)


# -- one scan for all folds -------------------------------------------------------


def linear_penalty(model: Estimator) -> tuple[float, float] | None:
    """(penalty, share of the absolute one) of a model that `linear_weights` solves, else None."""
    if isinstance(model, R.LinearRegression):
        plain = model.getFitIntercept() and model.getStandardization() and model.getLoss() == "squaredError" and not model.isDefined("weightCol")
        return (model.getRegParam(), model.getElasticNetParam()) if plain else None
    if isinstance(model, R.GeneralizedLinearRegression) and model.getFamily() == "gaussian" and model.getRegParam() == 0.0:
        return (0.0, 0.0) if model.getFitIntercept() and not (model.isDefined("link") and model.getLink() != "identity") else None
    return None


def class_kind(model: Estimator) -> str | None:
    """The kind for `class_terms` of a model that it solves, else None."""
    if isinstance(model, Discriminant):
        return "quadratic" if model.getOrDefault("quadratic") else "linear"
    return "naive_bayes" if isinstance(model, C.NaiveBayes) and model.getModelType() == "gaussian" else None


def regression_folds(df: DataFrame, features: Sequence[str], models: dict[str, Estimator], folds: int) -> tuple[DataFrame | None, list[str], dict[str, str]]:
    """(fold, label, predictions of every held-out row; the models of the predictions; model -> error); df: fold, y, x."""
    shaped = df.select("fold", F.lit(0).alias("label"), F.concat("x", F.array("y")).alias("x"))
    sums, errors = fold_sums(shaped, [*features, "y"], folds), {}
    lines: dict[str, list[tuple[float, np.ndarray]]] = {}
    for name, model in models.items():
        try:
            lines[name] = [linear_weights(sums.part(k), sums, *linear_penalty(model)) for k in range(folds)]
        except (ValueError, np.linalg.LinAlgError) as problem:
            errors[name] = f"{type(problem).__name__}: {problem}"
    if not lines:
        return None, [], errors
    constant = np.array([[line[k][0] for line in lines.values()] for k in range(folds)])  # folds x models
    weights = np.array([[line[k][1] for line in lines.values()] for k in range(folds)])  # folds x models x columns
    n = len(features)
    if n <= FEW_COLUMNS:
        own = lambda values: F.lit(values.tolist())[F.col("fold")]
        guesses = [reduce(lambda a, i: a + F.col("x")[i].cast("double") * own(weights[:, m, i]), range(n), own(constant[:, m])) for m in range(len(lines))]
        return df.select("fold", F.col("y").alias("label"), F.array(*guesses).alias("predictions")), list(lines), errors

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            p = np.empty((len(fold), len(lines)))
            for k in range(folds):
                own = np.flatnonzero(fold == k)
                p[own] = x[own] @ weights[k].T + constant[k]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, len(lines), dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("y"), lists], names=["fold", "label", "predictions"])

    return df.select("fold", "y", "x").mapInArrow(scored, "fold int, label double, predictions array<double>"), list(lines), errors


def class_folds(df: DataFrame, features: Sequence[str], models: dict[str, Estimator], folds: int, classes: int) -> tuple[Callable[..., DataFrame] | None, dict[str, str]]:
    """(scorer, model -> error); df: fold, label, x.

    The scorer gives model, fold, label, prediction, probabilities of every held-out row of a table like `df` by
    every model; with `counted` only model, fold, label, prediction and how many rows they have.
    """
    sums, rows, errors = fold_sums(df, features, folds, classes), [], {}
    for name, model in models.items():
        try:
            for k in range(folds):
                constant, linear, square = class_terms(class_kind(model), sums, k)
                rows.append((name, k, constant.tolist(), expanded(linear, square).tolist()))
        except (ValueError, np.linalg.LinAlgError) as problem:
            errors[name] = f"{type(problem).__name__}: {problem}"
    rows = [r for r in rows if r[0] not in errors]
    if not rows:
        return None, errors
    mean, scale, n = sums.mean, sums.scale, len(features)

    def guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(SCORED_CELLS // max(n, 1), 1)):
                b = batch.slice(at, max(SCORED_CELLS // max(n, 1), 1))
                fold = b.column("fold").to_numpy(zero_copy_only=False)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                for name, k, constant, weights in rows:
                    own = np.flatnonzero(fold == k)
                    if len(own):
                        guess, p = posterior(((x[own] - mean) / scale).T.copy(), constant, weights)
                        yield name, k, b.column("label").take(pa.array(own)), guess.astype(np.int32), p

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, k, label, guess, p in guesses(batches):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            same = [pa.array([name] * len(guess)), pa.array(np.full(len(guess), k, np.int32))]
            yield pa.RecordBatch.from_arrays([*same, label, pa.array(guess), lists], names=["model", "fold", "label", "prediction", "probabilities"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for name, k, label, guess, p in guesses(batches):
            codes, n = np.unique(label.to_numpy().astype(np.int64) * p.shape[1] + guess, return_counts=True)
            for code, m in zip(codes.tolist(), n.tolist()):
                total[name, k, *divmod(code, p.shape[1])] += m
        lines = [pa.array([key[i] for key in total], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*lines, pa.array(list(total.values()), pa.int64())], names=["model", "fold", "label", "prediction", "n"])

    def scorer(df: DataFrame, counted: bool = False) -> DataFrame:
        held, cell = df.select("fold", "label", "x"), "model string, fold int, label int, prediction int"
        if counted:
            return held.mapInArrow(cells, f"{cell}, n long").groupBy("model", "fold", "label", "prediction").agg(F.sum("n").alias("n"))
        return held.mapInArrow(scored, f"{cell}, probabilities array<double>")

    return scorer, errors


def posterior(z: np.ndarray, constant: list[float], weights: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """(most likely class, probabilities) of each row; z: a line for each column, weights as `expanded` has them.

    Sums run column by column, so that equal rows have equal scores wherever they stand.
    """
    scores = np.repeat(np.array(constant)[:, None], z.shape[1], 1)
    at = 0
    for j in range(len(z)):
        for term in (None, *range(j + 1)):
            used = [(k, w[at]) for k, w in enumerate(weights) if w[at] != 0]
            if used:
                value = z[j] if term is None else z[j] * z[term]
                for k, w in used:
                    scores[k] += w * value
            at += 1
    powers = np.exp(scores - scores.max(0))
    whole = powers[0].copy()
    for line in powers[1:]:
        whole += line
    return scores.argmax(0), (powers / whole).T.copy()
