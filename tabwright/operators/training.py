"""Model comparison on `pyspark.ml`: checks, split, folds, leaderboard, refit."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import prod
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, kinds
from ..functions.sizing import rows_if_bounded
from . import closed_form as closed
from .cells import bins_of, cell_sums, coded, drawn_sums, fold_cuts
from .metrics import RANGE_SAMPLE, auc_by, confusion_matrix, regression_metrics, regression_scores_wide, weighted_metrics

CLASSIFICATION_METRICS = ("accuracy", "auc", "f1", "precision", "recall")
REGRESSION_METRICS = ("r2", "rmse", "mae", "mape")
ROWS_PER_TASK = 50_000
CELL_ROWS = 1_000_000  # rows from which single and boosted regression trees are fitted on cells
DRAWN_ROWS = 1_000_000  # the same for forests, whose draws then differ from those made on rows
CELL_SHARE = 8  # cells are used when there is one for at least as many rows
BROADCAST_CELLS = 1_000_000
MOST_FITS = 16  # fits on cells that run side by side


def training_input_checks(df: DataFrame, target: str, task: str) -> DataFrame:
    """(check, passed, observed) from one aggregate."""
    found = target in df.columns
    y = col(target) if found else F.lit(None).cast("double")
    low, high = F.min(y), F.max(y)
    varied = F.when(low < high, 2).when(low.isNotNull(), 1).otherwise(0)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(y).alias("present"), varied.alias("distinct_up_to_2")
    ).first()
    share = 1 - row["present"] / row["rows"] if row["rows"] else 1.0
    checks = [
        ("enough_rows", row["rows"] >= fv.MIN_TRAINING_ROWS, float(row["rows"])),
        ("enough_columns", len(df.columns) >= 2, float(len(df.columns))),
        ("known_task", task in fv.TASKS, None),
        ("target_exists", found, None),
        ("target_not_all_null", row["present"] > 0, float(row["present"])),
        ("target_mostly_present", share <= 0.5, share),
        ("target_varies", row["distinct_up_to_2"] >= 2, None),
    ]
    return df.sparkSession.createDataFrame(checks, "check string, passed boolean, observed double")


def filter_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull())


def in_training_part(keys: Sequence[str]) -> Column:
    """80 % of the keys, the same ones in every run and on every cluster."""
    text = F.concat_ws("-", *[col(k).cast("string") for k in keys])
    return F.substring(F.md5(text), 1, 4) < "cccc"


def train_test_split(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    inside = in_training_part(keys)
    return df.where(inside), df.where(~inside)


def fold_count(rows: int, test_mode: bool = False) -> int:
    if test_mode and rows < 30:
        return 2
    return 3 if rows < 50 else 5


def fold_of(keys: Sequence[str], folds: int) -> Column:
    """The fold of a row, by a hash of its keys that any SQL engine can repeat."""
    head = F.substring(F.md5(F.concat_ws("-", F.lit("fold"), *[col(k).cast("string") for k in keys])), 1, 4)
    return sum(((head >= f"{-(-65536 * i // folds):04x}").cast("int") for i in range(1, folds)), F.lit(0))


def candidates(task: str, classes: int = 2, features: int = 1) -> dict[str, Estimator]:
    """The models that are compared."""
    if task == "regression":
        linear = lambda **kw: R.LinearRegression(maxIter=50, **kw)
        return {
            "linear": linear(),
            "ridge": linear(regParam=0.1, elasticNetParam=0.0),
            "lasso": linear(regParam=0.1, elasticNetParam=1.0),
            "elastic_net": linear(regParam=0.1, elasticNetParam=0.5),
            "glm": R.GeneralizedLinearRegression(family="gaussian"),
            "decision_tree": R.DecisionTreeRegressor(seed=123),
            "random_forest": R.RandomForestRegressor(seed=123),
            "boosted_trees": R.GBTRegressor(seed=123, maxIter=20),
        }
    models: dict[str, Estimator] = {
        "logistic": C.LogisticRegression(maxIter=50),
        "ridge_logistic": C.LogisticRegression(maxIter=50, regParam=0.1),
        "naive_bayes": C.NaiveBayes(modelType="gaussian"),
        "linear_discriminant": closed.Discriminant(quadratic=False),
        "quadratic_discriminant": closed.Discriminant(quadratic=True),
        "decision_tree": C.DecisionTreeClassifier(seed=123),
        "random_forest": C.RandomForestClassifier(seed=123),
        "perceptron": C.MultilayerPerceptronClassifier(layers=[features, 8, classes], seed=123, maxIter=50),
    }
    if classes == 2:
        models["boosted_trees"] = C.GBTClassifier(seed=123, maxIter=20)
        models["linear_svc"] = C.LinearSVC(maxIter=50)
        models["factorization"] = C.FMClassifier(seed=123, maxIter=50)
    return models


def fallback(task: str) -> Estimator:
    return C.LogisticRegression() if task == "classification" else R.LinearRegression()


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    folded = kinds(df)
    wide = vector_columns(df)
    return [c for c in df.columns if c != target and c not in exclude and (folded[c] in ("int", "float", "bool") or c in wide)]


def vector_columns(df: DataFrame) -> list[str]:
    """The columns that hold many features each, as categories with very many values do."""
    return [c for c, kind in df.dtypes if kind == "vector"]


def as_pipeline(model: Estimator, features: Sequence[str], target: str, stages: Sequence[Transformer] = ()) -> Pipeline:
    """Encoder stages, one assembler and the model: the same object trains and scores."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*stages, assembler, model.copy().setLabelCol(target).setFeaturesCol("features")])


def _scores(predicted: DataFrame, target: str, task: str, classes: int) -> dict[str, float]:
    if task == "regression":
        row = regression_metrics(predicted, target, "prediction").first()
        return {m: row[m] for m in REGRESSION_METRICS}
    cells = confusion_matrix(predicted, target, "prediction").collect()  # at most classes squared rows
    out = weighted_metrics([(int(r["label"]), int(r["prediction"]), r["n"]) for r in cells])
    out["auc"] = _auc(predicted, target, classes)
    return out


def _auc(predicted: DataFrame, target: str, classes: int) -> float | None:
    """Area under the curve; for several classes each against the rest, weighted by its rows."""
    if classes == 2:
        # Raw scores of some models are one number for each class, which does not rank rows by itself.
        found = next((c for c in ("probability", "rawPrediction") if c in predicted.columns), None)
        return BinaryClassificationEvaluator(labelCol=target, rawPredictionCol=found, numBins=0).evaluate(predicted) if found else None
    if "probability" not in predicted.columns:
        return None
    support = {r[0]: r[1] for r in predicted.groupBy(col(target)).count().collect()}  # one row per class
    p = vector_to_array(F.col("probability"))
    one = BinaryClassificationEvaluator(labelCol="__is", rawPredictionCol="__p", numBins=0)
    area = {
        k: one.evaluate(predicted.select((col(target) == k).cast("double").alias("__is"), p[k].alias("__p")))
        for k in range(classes) if support.get(k)
    }
    return sum(area[k] * support[k] for k in area) / sum(support[k] for k in area)


def compare_models(
    df: DataFrame,
    target: str,
    task: str,
    keys: Sequence[str],
    exclude: Sequence[str] = (),
    parallelism: int = 4,
    models: dict[str, Estimator] | None = None,
    training_rows: int | None = None,
) -> DataFrame:
    """(model, rank, folds_done, error, fold metrics averaged) for every candidate.

    Folds are a hash of `keys`.  Models with a closed form (the linear family, naive Bayes, discriminants)
    are solved for all folds from one scan and scored in a second one; regression trees of many rows are fitted
    on cells of binned features; for the others the assembled table is cached once and fits run side by side as
    `pyspark.ml.tuning` does.  Class labels may be any
    numbers; models see their positions.  `training_rows` bounds the rows that are compared on, by a hash
    of `keys` (None: all).  A model that fails in any fold has no metrics, only its error; when all fail
    the comparison does.
    """
    data = filter_null_target(df, target)
    features = feature_columns(data, target, keys)
    rows = data.count()
    if rows == 0:
        raise ValueError("no rows with a target")
    if training_rows is not None and rows > training_rows:
        share = F.pmod(F.xxhash64(F.lit("rows"), *[col(k) for k in keys]), F.lit(1_000_000))
        data = data.where(share < F.lit(training_rows * 1_000_000 // rows))
        rows = training_rows
    folds = fold_count(rows)
    classes = 0
    if task == "classification":
        levels = class_values(data, target)
        classes = len(levels)
        data = data.withColumn(target, F.array_position(F.array(*[F.lit(v) for v in levels]), col(target).cast("double")).cast("int") - 1)
    models = models or candidates(task, classes, len(features))
    models = {m: e for m, e in models.items() if m not in exclude}
    solved = (lambda e: closed.linear_penalty(e) is not None) if task == "regression" else (lambda e: closed.class_kind(e) is not None)
    if set(vector_columns(data)) & set(features):  # too many features for a matrix of all pairs
        solved = lambda e: False
    useful = min(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_TASK + 1)
    if data.rdd.getNumPartitions() < useful:
        data = data.repartition(useful, *[col(k) for k in keys])
    data = data.withColumn("__fold", fold_of(keys, folds)).select(col(target), "__fold", *[col(c) for c in features])
    if rows >= CELL_ROWS:  # read up to ten times; on disk, as partitions may be larger than what memory has left
        data = data.persist(StorageLevel.DISK_ONLY)
    try:
        results = _solved_folds(data, target, task, features, {m: e for m, e in models.items() if solved(e)}, folds, classes)
        results += _fitted_folds(data, target, task, features, {m: e for m, e in models.items() if not solved(e)}, folds, classes, parallelism, rows)
    finally:
        data.unpersist()
    names = CLASSIFICATION_METRICS if task == "classification" else REGRESSION_METRICS
    rows_out = []
    for m in models:
        own = [s for name, s in results if name == m]
        got = [s for s in own if isinstance(s, dict)]
        mean = lambda key: (lambda v: sum(v) / len(v) if v and len(got) == folds else None)([g[key] for g in got if g[key] is not None])
        rows_out.append((m, len(got), next((s for s in own if isinstance(s, str)), None), *[mean(k) for k in names]))
    if rows_out and not any(r[1] == folds for r in rows_out):
        raise RuntimeError("no model could be compared: " + "; ".join(f"{r[0]}: {r[2]}" for r in rows_out))
    schema = "model string, folds_done int, error string, " + ", ".join(f"{k} double" for k in names)
    return leaderboard(df.sparkSession.createDataFrame(rows_out, schema), task)


def _solved_folds(data: DataFrame, target: str, task: str, features: list[str], models: dict[str, Estimator], folds: int, classes: int) -> list:
    """(model, metrics of a fold or error) of models with a closed form."""
    if not models:
        return []
    x = F.array(*[col(c).cast("double") for c in features])
    if task == "regression":
        rows = data.select(F.col("__fold").alias("fold"), col(target).cast("double").alias("y"), x.alias("x"))
        scored, fitted, errors = closed.regression_folds(rows, features, models, folds)
        names = [f"p{i}" for i in range(len(fitted))]
        wide = scored and regression_scores_wide(scored.select("fold", "label", *[F.col("predictions")[i].alias(p) for i, p in enumerate(names)]), ["fold"], "label", names)
        found = [(m, r[p].asDict()) for r in (wide.collect() if wide else []) for m, p in zip(fitted, names)]
        return found + list(errors.items())
    rows = data.select(F.col("__fold").alias("fold"), col(target).cast("int").alias("label"), x.alias("x"))
    scorer, errors = closed.class_folds(rows, features, models, folds, classes)
    if scorer is None:
        return list(errors.items())
    cells = scorer(rows, counted=True).collect()  # models x folds x classes squared

    def each(scored: DataFrame) -> DataFrame:
        one = scored.select("model", "fold", "label", F.posexplode("probabilities").alias("class", "p"))
        return one.where(F.col("class") == 1 if classes == 2 else F.lit(True)).withColumn("own", (F.col("label") == F.col("class")).cast("int"))

    scores = sum(r["n"] for r in cells) * (1 if classes == 2 else classes)
    some = each(scorer(rows.sample(min(1.0, RANGE_SAMPLE / max(scores, 1)), 42)))
    areas = auc_by(each(scorer(rows)), ["model", "fold", "class"], "own", "p", scores, some).collect()
    found = []
    for m, k in sorted({(r["model"], r["fold"]) for r in cells}):
        own = [(r["label"], r["prediction"], r["n"]) for r in cells if (r["model"], r["fold"]) == (m, k)]
        support = {c: sum(n for label, _, n in own if label == c) for c in range(classes)}
        area = {r["class"]: r["auc"] for r in areas if (r["model"], r["fold"]) == (m, k) and r["auc"] is not None}
        weight = {c: 1 if classes == 2 else support[c] for c in area}
        mean = sum(area[c] * weight[c] for c in area) / sum(weight.values()) if area else None
        found.append((m, weighted_metrics(own) | {"auc": mean}))
    return found + list(errors.items())


def _fitted_folds(
    data: DataFrame, target: str, task: str, features: list[str], models: dict[str, Estimator], folds: int, classes: int, parallelism: int, rows: int | None = None
) -> list:
    """(model, metrics of a fold or error) of models that are fitted fold by fold.

    Of many rows, regression trees, single, boosted or in forests, are fitted on cells; the others see the rows, one
    fit at a time then, as each one holds its own copy of them.
    """
    if not models:
        return []
    jobs = [(m, k) for m in models for k in range(folds)]
    found: dict[tuple[str, int], dict | str] = {}
    many = False
    if task == "regression" and any(fits_on_cells(e) or draws_on_cells(e) for e in models.values()) and not set(vector_columns(data)) & set(features):
        rows = data.count() if rows is None else rows
        many = rows >= CELL_ROWS
        on_cells = {m: e for m, e in models.items() if (many and fits_on_cells(e)) or (rows >= DRAWN_ROWS and draws_on_cells(e))}
        found = _cell_folds(data, target, features, on_cells, folds, parallelism) if on_cells else {}
    left = [j for j in jobs if j not in found]
    if not left:
        return [(m, found[m, k]) for m, k in jobs]
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    table = assembler.transform(data).select(target, "__fold", "features").cache()

    def one(job: tuple[str, int]) -> dict | str:
        name, k = job
        try:
            fitted = models[name].copy().setLabelCol(target).fit(table.where(F.col("__fold") != k))
            return _scores(fitted.transform(table.where(F.col("__fold") == k)), target, task, classes)
        except Exception as problem:  # reported with the model
            return _told(problem)

    try:
        with ThreadPoolExecutor(1 if many else parallelism) as pool:
            found |= dict(zip(left, pool.map(one, left)))
        return [(m, found[m, k]) for m, k in jobs]
    finally:
        table.unpersist()


def _told(problem: Exception) -> str:
    return f"{type(problem).__name__}: {str(problem)[:300]}"


def _plain_tree(model: Estimator) -> bool:
    """Whether splits and leaves of the trees depend on counts and sums of the target alone."""
    get = lambda name: model.getOrDefault(name) if model.hasParam(name) and (model.isSet(name) or model.hasDefault(name)) else None
    plain = {"minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "minInfoGain": 0.0, "impurity": "variance"}
    if any(get(name) not in (value, None) for name, value in plain.items()):
        return False
    return get("weightCol") is None and get("validationIndicatorCol") is None and get("varianceCol") is None


def fits_on_cells(model: Estimator) -> bool:
    """A regression tree, single or boosted, whose splits depend on counts and sums of the target alone, without draws."""
    if isinstance(model, R.GBTRegressor):
        whole = model.getSubsamplingRate() == 1.0 and model.getFeatureSubsetStrategy() == "all"
        return whole and model.getLossType() == "squared" and _plain_tree(model)
    return isinstance(model, R.DecisionTreeRegressor) and _plain_tree(model)


def draws_on_cells(model: Estimator) -> bool:
    """A forest of such trees, each grown on Poisson draws of the rows."""
    return isinstance(model, R.RandomForestRegressor) and model.getBootstrap() and _plain_tree(model)


class FoldRows(NamedTuple):
    """What the trees of a fold are scored on: (code, y) of all rows, their sums by code, (code, features) of the fold."""

    rows: DataFrame
    sums: DataFrame
    held: DataFrame


def fold_cells(
    table: DataFrame, target: str, features: Sequence[str], folds: int, bins: int, draws: Sequence[tuple[int, int, float]] = ()
) -> dict[int, tuple[FoldRows, DataFrame, int]]:
    """fold -> (its rows, the cells of the rows outside the fold with __n and the mean target, their number).

    A tree that splits by at most `bins` bins of a feature sees rows of equal bins as one, and the squares of the
    target within a cell cancel out of every gain; so trees grown on weighted cell means are those grown on the rows.
    `draws` (seed, trees, rate) of forests give __w0, __s0, __w1, ... too: how often the rows of a cell are drawn for a
    tree, and the sum of their targets; left out when these numbers would be more than those of the rows.  Empty when
    a feature has nulls, NaN or infinity, or when cells are hardly fewer than rows.
    """
    found = fold_cuts(table, features, folds, bins)
    if found is None:
        return {}
    count, cuts = found
    edges = [np.unique(np.concatenate(c)) for c in zip(*cuts)]
    if prod(len(e) + 1 for e in edges) * folds >= 1 << 62:
        return {}
    rows = coded(table, target, features, edges, folds).persist(StorageLevel.DISK_ONLY)
    kept, parts = [rows], {}
    sums = cell_sums(rows).cache()
    kept.append(sums)
    codes = sums.count()
    numbers = 2 * sum(trees for _, trees, _ in draws)
    drawn = [f"{c}{t}" for t in range(numbers // 2) for c in "ws"] if codes * (numbers + 2) <= count * (len(features) + 2) else []
    if 2 * codes <= count:
        if drawn:
            sums = reduce(lambda a, b: a.join(b, "code"), drawn_sums(rows, draws), sums).cache()
            kept.append(sums)
        names = [f"__bin_{i}" for i in range(len(features))]
        assembled = VectorAssembler(inputCols=names, outputCol="features").transform
        sums.count()

        def part(k: int) -> tuple[FoldRows, DataFrame, int]:
            binned = sums.select("*", *[b.alias(n) for n, b in zip(names, bins_of(edges, cuts[k], folds))])
            inside = F.col("code") % folds == k
            totals = [F.sum("n").alias("__n"), (F.sum("s") / F.sum("n")).alias(target), *[F.sum(c).alias(f"__{c}") for c in drawn]]
            cells = assembled(binned.where(~inside).groupBy(*names).agg(*totals)).drop(*names)
            cells = cells.coalesce(codes // ROWS_PER_TASK + 1).cache()
            kept.append(cells)
            return FoldRows(rows, sums, assembled(binned.where(inside)).select("code", "features")), cells, cells.count()

        with ThreadPoolExecutor(folds) as pool:
            parts = dict(enumerate(pool.map(part, range(folds))))
    if not parts or any(n * CELL_SHARE > count for _, _, n in parts.values()):
        for df in kept:
            df.unpersist()
        return {}
    return parts


def _cell_folds(table: DataFrame, target: str, features: list[str], models: dict[str, Estimator], folds: int, parallelism: int) -> dict[tuple[str, int], dict | str]:
    """(model, fold) -> metrics or error of trees fitted on cells; without those that cells do not do for.

    Each tree of a forest is grown on its own draws.  All models are scored in one pass over the rows.
    """
    forests = [m for m, e in models.items() if draws_on_cells(e)]
    draws = [(models[m].getSeed(), models[m].getNumTrees(), models[m].getSubsamplingRate()) for m in forests]
    parts = fold_cells(table, target, features, folds, max(e.getMaxBins() for e in models.values()), draws)
    if not parts:
        return {}
    first, at = {}, 0
    for m, (_, trees, _) in zip(forests, draws):
        first[m], at = at, at + trees
    fitted_on = [m for m in models if m not in forests or "__w0" in parts[0][1].columns]

    def grown(job: tuple[str, int, int | None]):
        name, k, t = job
        _, cells, n = parts[k]
        try:
            model = models[name].copy().setLabelCol(target).setWeightCol("__n")
            model = model.setMaxBins(max(model.getMaxBins(), int(n**0.5) + 2))  # so that no bin is left out by sampling cells
            return model.fit(cells) if t is None else tree_of_forest(model, t, first[name] + t, cells, target)
        except Exception as problem:  # reported with the model
            return _told(problem)

    try:
        ordered = sorted(fitted_on, key=lambda m: not isinstance(models[m], R.GBTRegressor))  # the longest first
        jobs = [(m, k, t) for m in ordered for k in range(folds) for t in (range(models[m].getNumTrees()) if m in forests else [None])]
        with ThreadPoolExecutor(max(parallelism, min(table.sparkSession.sparkContext.defaultParallelism, MOST_FITS))) as pool:
            done = dict(zip(jobs, pool.map(grown, jobs)))
        found: dict[tuple[str, int], dict | str] = {}
        guesses = []
        for k in range(folds):
            scored = parts[k][0].held
            for i, m in enumerate(fitted_on):
                own = [done[j] for j in jobs if j[:2] == (m, k)]
                error = next((o for o in own if isinstance(o, str)), None)
                if error is None:
                    scored = (forest_of(own) if m in forests else own[0]).setPredictionCol(f"p{i}").transform(scored)
                else:
                    found[m, k] = error
                    scored = scored.withColumn(f"p{i}", F.lit(None).cast("double"))
            guesses.append(scored.drop("features"))
        guesses = reduce(DataFrame.unionByName, guesses)
        rows, sums = parts[0][0].rows, parts[0][0].sums
        few = sums.count() <= BROADCAST_CELLS
        scored = rows.join(F.broadcast(guesses) if few else guesses, "code").withColumn("fold", F.col("code") % folds)
        names = [f"p{i}" for i in range(len(fitted_on))]
        metrics = {r["fold"]: r for r in regression_scores_wide(scored, ["fold"], "y", names).collect()}
        for i, m in enumerate(fitted_on):
            for k in range(folds):
                found.setdefault((m, k), {c: metrics[k][names[i]][c] if k in metrics else None for c in REGRESSION_METRICS})
        return found
    finally:
        for held, cells, _ in parts.values():
            for df in (held.rows, held.sums, cells):
                df.unpersist()


def tree_of_forest(forest: R.RandomForestRegressor, tree: int, draw: int, cells: DataFrame, target: str) -> R.RandomForestRegressionModel:
    """One tree of a forest, grown on the rows of its own draw; it tries as many features a node as the forest does."""
    times, total = F.col(f"__w{draw}"), F.col(f"__s{draw}")
    own = cells.where(times > 0).select((total / times).alias(target), times.alias("__n"), "features")
    strategy = forest.getFeatureSubsetStrategy()
    if strategy == "auto":
        strategy = "onethird" if forest.getNumTrees() > 1 else "all"
    alone = forest.copy().setNumTrees(1).setBootstrap(False).setSubsamplingRate(1.0).setFeatureSubsetStrategy(strategy)
    return alone.setSeed(forest.getSeed() + tree).fit(own)


def forest_of(trees: Sequence[R.RandomForestRegressionModel]) -> R.RandomForestRegressionModel:
    """The forest of forests of one tree."""
    spark = SparkSession.active()
    kind = spark._jvm.org.apache.spark.ml.regression
    array = spark.sparkContext._gateway.new_array(kind.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree._java_obj.trees()[0]
    whole = kind.RandomForestRegressionModel(trees[0].uid, array, trees[0].numFeatures)
    whole.set("numTrees", len(trees))  # what predictions are divided by
    return R.RandomForestRegressionModel(whole)


def class_values(df: DataFrame, target: str, limit: int = fv.MOST_CLASSES) -> list[float]:
    """The sorted distinct labels of a numeric target; refuses more than `limit`."""
    rows = rows_if_bounded(df.select(col(target).cast("double").alias("v")).distinct(), limit)
    if rows is None:
        raise ValueError(f"{target} has more than {limit} classes")
    return sorted(r["v"] for r in rows)


def leaderboard(table: DataFrame, task: str, by: str | None = None) -> DataFrame:
    """Add `rank` (best first, ties to nine digits by name); the table has one row per model."""
    by = by or ("accuracy" if task == "classification" else "r2")
    metric = F.round(F.col(by), 9)
    best = metric.desc_nulls_last() if by not in ("rmse", "mae", "mape") else metric.asc_nulls_last()
    return table.withColumn("rank", F.row_number().over(Window.orderBy(best, "model")))


def top_models(table: DataFrame, n: int = 5) -> DataFrame:
    return table.orderBy("rank").limit(n)


def winner(table: DataFrame, task: str, classes: int = 2, features: int = 1) -> tuple[str, Estimator]:
    """The best model's name and estimator; the plain linear model if there is none."""
    row = table.orderBy("rank").first()
    if row is None or ("error" in table.columns and row["error"] is not None):
        return "fallback", fallback(task)
    return row["model"], candidates(task, classes, features)[row["model"]]


def finalize(model: Estimator, df: DataFrame, target: str, exclude: Sequence[str] = (), stages: Sequence[Transformer] = ()) -> PipelineModel:
    """Refit on all rows that have a target."""
    data = filter_null_target(df, target)
    shaped = reduce(lambda d, s: s.transform(d), stages, data)
    pipe = as_pipeline(model, feature_columns(shaped, target, exclude), target, stages)
    return pipe.fit(data)


def class_labels(df: DataFrame, target: str) -> DataFrame:
    """(label) sorted distinct target values as text."""
    return df.where(col(target).isNotNull()).select(col(target).cast("string").alias("label")).distinct().orderBy("label")


def samples_per_feature(df: DataFrame, target: str) -> DataFrame:
    """(n_rows, n_features, ratio, enough)."""
    features = len([c for c in df.columns if c != target])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(features).alias("n_features"),
        (F.col("n_rows") / F.lit(features)).alias("ratio"), (F.col("n_rows") / F.lit(features) >= 10).alias("enough"),
    )


def model_card(table: DataFrame, model: PipelineModel, target: str, rows: int) -> DataFrame:
    """One row: the winner, its metrics, the training shape and the target."""
    width = len(next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols())
    return top_models(table, 1).select(
        "*", F.lit(target).alias("target"), F.lit(rows).alias("n_rows"), F.lit(width).alias("n_features")
    )
