import random

import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import explaining as X, forms, metrics as M, scoring as S, training as T, whatif as W


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        a, b, c = rng.random(), rng.gauss(0, 1), float(rng.randrange(5))
        rows.append((i, a, b, c, 3 * a - 2 * b + c + rng.gauss(0, 0.1), int(a + b > 0.5)))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, label int").cache()


@pytest.mark.parametrize("path", ["small", "ranges"])
def test_auc_equals_pair_counting(spark, monkeypatch, path):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(400)]
    if path == "ranges":
        monkeypatch.setattr(M, "DRIVER_ROWS", 5)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = M.auc(spark.createDataFrame(rows, "s double, y int"), "y", "s").first()["auc"]
    assert got == pytest.approx(want)


def test_attributions_add_up(numbers):
    features = ["a", "b", "c"]
    linear = T.finalize(R.LinearRegression(), numbers.select(*features, "y"), "y")
    weights = dict(zip(features, map(float, linear.stages[-1].coefficients)))
    phi = X.linear_attribution(numbers, ["id"], weights).groupBy("id").agg(F.sum("phi").alias("total"))
    base = linear.transform(numbers).agg(F.avg("prediction")).first()[0]
    gap = linear.transform(numbers).join(phi, "id").select(F.max(F.abs(F.col("prediction") - base - F.col("total")))).first()[0]
    assert gap < 1e-9

    tree = T.finalize(C.DecisionTreeClassifier(), numbers.select("id", *features, "label"), "label", ["id"])
    output = vector_to_array(F.col("probability"))[1]
    sample = X.explain_sample(numbers, ["id"], 20)
    phi = X.shapley_by_permutation(tree, sample, ["id"], features, output, permutations=2, background_rows=5)
    back = tree.transform(X.explain_sample(numbers, ["id"], 5)).agg(F.avg(output)).first()[0]
    totals = phi.groupBy("id").agg(F.sum("phi").alias("total"))
    gap = tree.transform(sample).join(totals, "id").select(F.max(F.abs(output - back - F.col("total")))).first()[0]
    assert gap < 1e-9 and phi.count() == 60


def test_linear_shapley_by_permutation_is_exact(numbers):
    features = ["a", "b", "c"]
    model = T.finalize(R.LinearRegression(), numbers.select(*features, "y"), "y")
    weights = dict(zip(features, map(float, model.stages[-1].coefficients)))
    back = X.explain_sample(numbers, ["id"], 10).agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    sample = X.explain_sample(numbers, ["id"], 15)
    got = {(r["id"], r["feature"]): r["phi"] for r in X.shapley_by_permutation(model, sample, ["id"], features).collect()}
    want = {(r["id"], r["feature"]): r["phi"] for r in X.linear_attribution(sample, ["id"], weights, back).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_comparison_ranks_the_right_model_first(numbers):
    models = {k: v for k, v in T.candidates("regression").items() if k in ("linear", "decision_tree")}
    board = T.compare_models(numbers.drop("label"), "y", "regression", ["id"], models=models)
    rows = board.orderBy("rank").collect()
    assert [r["model"] for r in rows] == ["linear", "decision_tree"] and rows[0]["r2"] > 0.98
    assert T.winner(board, "regression")[0] == "linear"
    assert T.winner(board.limit(0), "classification")[0] == "fallback"


def test_fold_count_and_split(numbers):
    assert (T.fold_count(20, True), T.fold_count(40), T.fold_count(50)) == (2, 3, 5)
    train, test = T.train_test_split(numbers, ["id"])
    assert train.count() + test.count() == 200 and 0.7 < train.count() / 200 < 0.9


def test_training_checks_find_problems(numbers):
    bad = numbers.limit(10).select("a", F.lit(None).cast("int").alias("label"))
    got = {r["check"]: r["passed"] for r in T.training_input_checks(bad, "label", "ranking").collect()}
    assert not any(got[k] for k in ("enough_rows", "known_task", "target_not_all_null", "target_mostly_present", "target_varies"))


def test_streams_score_like_batches(spark, numbers, tmp_path):
    model = T.finalize(R.LinearRegression(), numbers.select("a", "b", "y"), "y")
    numbers.select("id", "a", "b").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, a double, b double").parquet(str(tmp_path / "in"))
    q = model.transform(stream).select("id", "prediction").writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = model.transform(numbers).select("id", "prediction")
    assert spark.table("scored").exceptAll(want).count() == 0 and spark.table("scored").count() == 200


def test_alignment_and_errors(spark):
    df = spark.createDataFrame([("1.5", 2, "x"), ("bad", None, "y")], "a string, b int, extra string")
    rows = S.feature_align(df, ["b", "a", "absent"]).collect()
    assert [tuple(r) for r in rows] == [(2.0, 1.5, 0.0), (0.0, 0.0, 0.0)]
    errors = [r["error"] for r in S.batch_error_rows(df, ["a", "b"]).collect()]
    assert errors == [None, "a is not a number"]
    assert len(S.column_set_diff(df, ["a", "absent"], "b")) == 4


def test_steps():
    assert forms.form_step(0, 0.1) == 0.001 and forms.form_step(1, 7) == 0.06 and forms.form_step(5, 5) == 1.0
    assert forms.slider_step(0, 0.08) == (0.0008, ".5f") and forms.slider_step(0, 1000) == (10.0, ".0f")


def test_monotonicity_of_a_rising_sweep(spark):
    swept = W.sweep(spark.createDataFrame([(1, 0.0)], "id int, x double"), "x", [1, 2, 3, 4]).withColumn("prediction", F.col("x") * 2)
    row = W.sweep_monotonicity(swept, ["id"], [1, 2, 3, 4]).first()
    assert row["rising_pct"] == 100 and row["r"] == pytest.approx(1) and row["range_pct"] == pytest.approx(120)


def test_several_classes(spark, numbers):
    rows = numbers.select("id", "a", "b", F.least(F.floor(F.col("a") * 3), F.lit(2)).cast("int").alias("label"))
    models = {k: v for k, v in T.candidates("classification", 3, 2).items() if k in ("decision_tree", "naive_bayes")}
    board = {r["model"]: r for r in T.compare_models(rows, "label", "classification", ["id"], models=models).collect()}
    assert board["decision_tree"]["auc"] > 0.9 and board["naive_bayes"]["auc"] > 0.9
    model = T.finalize(C.DecisionTreeClassifier(maxBins=256), rows, "label", ["id"])  # bins fine enough to split on `a` alone
    phi = X.shapley_by_permutation(model, X.explain_sample(rows, ["id"], 10), ["id"], ["a", "b"], X.class_outputs(model, 3), permutations=1)
    sums = phi.select(F.aggregate("phi", F.lit(0.0), lambda x, y: x + y).alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert sums < 1e-9  # probabilities add up to one, so their changes add up to zero
    score = {r["feature"]: r["score"] for r in X.global_importance(phi).collect()}
    assert score["a"] > 10 * score["b"]


def test_closed_forms_equal_the_fitted_models(numbers):
    """The same folds, by matrices and by fits."""
    models = {k: v for k, v in T.candidates("regression").items() if k in ("linear", "ridge", "lasso", "elastic_net", "glm")}
    rows = numbers.select("id", "a", "b", "c", "y")
    board = {r["model"]: r for r in T.compare_models(rows, "y", "regression", ["id"], models=models).collect()}
    data = rows.withColumn("__fold", T.fold_of(["id"], 5))
    for name, model in models.items():
        tight = model.copy().setTol(1e-12).setMaxIter(1000)
        got = T._fitted_folds(data, "y", "regression", ["a", "b", "c"], {name: tight}, 5, 0, 2)
        for metric in T.REGRESSION_METRICS:
            assert board[name][metric] == pytest.approx(sum(s[metric] for _, s in got) / 5, rel=1e-5), (name, metric)
    labels = numbers.select("id", "a", "b", "c", "label")
    models = {k: v for k, v in T.candidates("classification", 2, 3).items() if k in ("naive_bayes", "linear_discriminant", "quadratic_discriminant")}
    board = {r["model"]: r for r in T.compare_models(labels, "label", "classification", ["id"], models=models).collect()}
    data = labels.withColumn("__fold", T.fold_of(["id"], 5))
    for name, model in models.items():
        got = T._fitted_folds(data, "label", "classification", ["a", "b", "c"], {name: model}, 5, 2, 2)
        for metric in T.CLASSIFICATION_METRICS:
            assert board[name][metric] == pytest.approx(sum(s[metric] for _, s in got) / 5, abs=1e-9), (name, metric)


def test_discriminants_in_numpy_and_reloaded(spark, numbers, tmp_path):
    import numpy as np
    from pyspark.ml import PipelineModel

    features = ["a", "b", "c"]
    rows = numbers.select(*features, "label")
    x = np.array([r[:3] for r in rows.collect()])
    y = np.array([r[3] for r in rows.collect()])
    cov = [np.cov(x[y == k].T) for k in (0, 1)]
    pooled = sum((np.sum(y == k) - 1) * cov[k] for k in (0, 1)) / (len(y) - 2)
    for kind, use in (("linear", [pooled, pooled]), ("quadratic", cov)):
        model = T.finalize(T.candidates("classification", 2, 3)[f"{kind}_discriminant"], rows, "label")
        model.write().overwrite().save(str(tmp_path / kind))
        back = PipelineModel.load(str(tmp_path / kind))
        p = [r[0] for r in back.transform(rows).select(vector_to_array(F.col("probability"))[1]).collect()]
        score = np.array([
            np.log(np.mean(y == k)) - 0.5 * np.linalg.slogdet(use[k])[1] - 0.5 * np.einsum("ni,ij,nj->n", x - x[y == k].mean(0), np.linalg.inv(use[k]), x - x[y == k].mean(0))
            for k in (0, 1)
        ])
        assert p == pytest.approx(1 / (1 + np.exp(score[0] - score[1])), abs=1e-9)


def test_a_model_that_cannot_be_solved_is_reported(numbers):
    twice = numbers.select("id", "a", (F.col("a") * 2).alias("a2"), "label")
    models = {k: v for k, v in T.candidates("classification", 2, 2).items() if k in ("naive_bayes", "quadratic_discriminant")}
    board = {r["model"]: r for r in T.compare_models(twice, "label", "classification", ["id"], models=models).collect()}
    assert "depend" in board["quadratic_discriminant"]["error"] and board["naive_bayes"]["error"] is None and board["naive_bayes"]["folds_done"] == 5


def test_areas_of_many_groups(spark):
    rng = random.Random(3)
    rows = [(g, round(rng.random(), 1 + g), int(rng.random() < 0.4)) for g in range(3) for _ in range(200)]
    got = {r["g"]: r["auc"] for r in M.auc_by(spark.createDataFrame(rows, "g int, s double, y int"), ["g"], "y", "s").collect()}
    for g in range(3):
        pos, neg = [s for k, s, y in rows if k == g and y], [s for k, s, y in rows if k == g and not y]
        assert got[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_kernel_attribution(numbers):
    """All coalitions give exact values; a drawn design of many features adds up and is exact for a linear model."""
    import itertools
    import math

    features = ["a", "b", "c"]
    tree = T.finalize(R.DecisionTreeRegressor(maxDepth=4), numbers.select(*features, "y"), "y")
    sample = X.explain_sample(numbers, ["id"], 8)
    back = X.explain_sample(numbers, ["id"], 3).select(*features).collect()
    got = {(r["id"], r["feature"]): r["phi"] for r in X.kernel_attribution(tree, sample, ["id"], features, background=back).collect()}
    rows = [r for r in sample.collect()]
    grid = [(r["id"], s, *[r[c] if s >> j & 1 else b[j] for j, c in enumerate(features)]) for r in rows for s in range(8) for b in back]
    scored = tree.transform(numbers.sparkSession.createDataFrame(grid, "id int, s int, a double, b double, c double"))
    value = {(r["id"], r["s"]): r["v"] for r in scored.groupBy("id", "s").agg(F.avg("prediction").alias("v")).collect()}
    for r in rows:
        for j, c in enumerate(features):
            want = 0.0
            for size in range(3):
                for chosen in itertools.combinations([k for k in range(3) if k != j], size):
                    s = sum(1 << k for k in chosen)
                    want += math.factorial(size) * math.factorial(2 - size) / 6 * (value[r["id"], s | 1 << j] - value[r["id"], s])
            assert got[r["id"], c] == pytest.approx(want, abs=1e-9)

    names = [f"x{j}" for j in range(14)]
    wide = numbers.select("id", *[(F.col("a") * (j + 1) + F.sin(F.col("id") * (j + 1))).alias(x) for j, x in enumerate(names)], "y").limit(40)
    linear = T.finalize(R.LinearRegression(regParam=0.1), wide.drop("id"), "y")
    weights = dict(zip(names, map(float, linear.stages[-1].coefficients)))
    base = wide.select(*names).first()
    phi = X.kernel_attribution(linear, wide.limit(5), ["id"], names, background=[base], most=200).collect()
    rows = {r["id"]: r for r in wide.collect()}
    assert {(r["id"], r["feature"]): r["phi"] for r in phi} == pytest.approx({(r["id"], r["feature"]): weights[r["feature"]] * (rows[r["id"]][r["feature"]] - base[r["feature"]]) for r in phi}, abs=1e-7)
    assert len(X.coalitions(14, 200)) <= 200 and len(X.coalitions(5)) == 30
