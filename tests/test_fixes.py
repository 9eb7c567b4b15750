"""CSV cells, labels of any value, failing models, unique text, wide attribution."""

import pytest
from pyspark.ml import classification as C, regression as R
from pyspark.sql import functions as F

from tabwright.operators import encoding as E, expectations as Q, explaining as X, forms, importance as I, roles, training as T
from tabwright.sources import tables


def test_csv_quotes_lines_and_missing_cells(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('n,said,x,flag\n10,"He said ""hi"", ok",1.5,true\nNA,"two\nlines",null,False\n30,N/A,-2e3,\n')
    df = tables.scan_csv(spark, str(path), multi_line=True)
    assert df.dtypes == [("n", "int"), ("said", "string"), ("x", "double"), ("flag", "boolean")]
    assert [tuple(r) for r in df.collect()] == [(10, 'He said "hi", ok', 1.5, True), (None, "two\nlines", None, False), (30, None, -2000.0, None)]


def signed(spark):
    return spark.range(240).selectExpr("id", "CAST(id % 3 * 10 - 10 AS DOUBLE) AS y", "CAST(id % 3 AS DOUBLE) + rand(1) / 10 AS x")


def test_labels_below_zero_and_with_gaps(spark):
    models = {"bayes": C.NaiveBayes(modelType="gaussian"), "broken": C.LinearSVC(maxIter=2)}
    board = {r["model"]: r for r in T.compare_models(signed(spark), "y", "classification", ["id"], models=models).collect()}
    assert board["bayes"]["accuracy"] == 1.0 and board["bayes"]["folds_done"] == 5 and board["bayes"]["error"] is None
    assert board["broken"]["folds_done"] == 0 and board["broken"]["accuracy"] is None and board["broken"]["error"]  # takes two classes only
    assert board["bayes"]["rank"] == 1
    with pytest.raises(RuntimeError):
        T.compare_models(signed(spark), "y", "classification", ["id"], models={"broken": C.LinearSVC(maxIter=2)})
    assert T.winner(spark.createDataFrame([], "model string, rank int"), "classification")[0] == "fallback"
    codes = E.Encoder([E.fit_target(signed(spark), roles.Target("y", "classification", "multiclass_int_labels"))]).transform(signed(spark))
    assert {(r["id"] % 3, r["y"]) for r in codes.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_comparison_on_a_bounded_sample(spark):
    models = {"bayes": C.NaiveBayes(modelType="gaussian")}
    board = T.compare_models(signed(spark), "y", "classification", ["id"], models=models, training_rows=100).first()
    assert board["folds_done"] == 5


def test_unique_text_scores_nothing(spark):
    df = spark.range(400).selectExpr("concat('n', id) AS name", "id % 2 AS y", "concat('g', id % 2) AS same", "id % 7 AS other")
    got = {r["column_name"]: r["mi"] for r in I.mutual_info_scores(df, roles.Target("y", "classification", "binary_01")).collect()}
    assert got["same"] > 0.65 and got["name"] < 0.2 and I.key_features(df, roles.Target("y", "classification", "binary_01"), 1) == ["same"]


def test_attribution_makes_two_parts_a_row(spark):
    names = [f"f{i}" for i in range(40)]
    df = spark.range(30).select("id", *[F.rand(i).alias(c) for i, c in enumerate(names)]).cache()
    model = T.as_pipeline(R.DecisionTreeRegressor(seed=1), names, "y").fit(df.withColumn("y", F.col("f0") * 3 + F.col("f7")))
    phi = X.shapley_by_permutation(model, df, ["id"], names, permutations=1, background_rows=4)
    total = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    base = model.transform(X.explain_sample(df, ["id"], 4)).agg(F.avg("prediction")).first()[0]
    assert all(abs(total[r["id"]] - (r["prediction"] - base)) < 1e-9 for r in model.transform(df).collect())
    assert phi.count() == 30 * 40


def test_three_thousand_categories_are_features_each(spark, tmp_path):
    df = spark.range(6_000).selectExpr("id", "CASE WHEN id > 5 THEN concat('city', lpad(id % 3000, 4, '0')) END AS city", "id % 2 AS y")
    encoder = E.fit_encoder(df, {"city": "categorical-nominal", "id": "identifier_ignore"})
    stage = encoder.as_stage(df)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    new = df.withColumn("city", F.when(F.col("id") == 7, "elsewhere").otherwise(F.col("city")))
    got = type(stage).load(str(tmp_path / "stage")).transform(new)
    assert got.columns == ["city", "y"] and got.count() == 6_000
    kept = encoder.transform(df.withColumn("n", F.col("id"))).select("n", "city").collect()
    assert {r["n"]: list(r["city"].indices) for r in kept} == {i: [i % 3000] if i > 5 else [] for i in range(6_000)}
    none = [r for r in got.collect() if not len(r["city"].indices)]
    assert len(none) == 7 and {r["city"].size for r in none} == {3000} and "city" in dict(encoder.column_mapping(df)).values()


def test_bounds_learned_from_a_reference_table(spark):
    old, new = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS x"), spark.range(100).selectExpr("CAST(id * 2 AS DOUBLE) AS x")
    suite = Q.build_suite(["x"], {"x": ("float", "numeric-continuous")}, bounds=Q.numeric_bounds(old))
    result = lambda df: {r["expectation"]: r["success"] for r in Q.run_suite(df, suite).collect()}[Q.fv.EXP_BETWEEN]
    assert result(old) and not result(new)


def test_model_card_and_tier_counts(spark):
    df = spark.range(60).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id * 2 AS DOUBLE) AS y")
    board = T.compare_models(df, "y", "regression", ["id"], models={"linear": R.LinearRegression()})
    card = T.model_card(board, T.finalize(R.LinearRegression(), df, "y", exclude=["id"]), "y", 60).first()
    assert (card["model"], card["target"], card["n_rows"], card["n_features"]) == ("linear", "y", 60, 1)
    tiers = I.tiers(spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.0)], "column_name string, score double"))
    counts = {(r["grouping"], r["key"]): r["n"] for r in forms.tier_counts(tiers.withColumn("category", F.lit("other"))).collect()}
    assert counts[("category", "other")] == 3 and sum(n for (g, _), n in counts.items() if g == "tier") == 3


def test_edge_rows_of_few_rows_ties_and_holes(spark):
    from tabwright.operators.profiling import edge_rows

    df = spark.createDataFrame([(2, "b"), (None, "z"), (2, "a")], "k int, v string")
    got = [tuple(r) for r in edge_rows(df, ["k"], 2).orderBy("part", "position").collect()]
    assert got == [("head", 1, None, "z"), ("head", 2, 2, "a"), ("tail", 1, 2, "b"), ("tail", 2, 2, "a")]
    assert edge_rows(df.limit(0), ["k"]).collect() == []


def test_column_statistics_of_long_texts_ties_and_holes(spark):
    from tabwright.operators.profiling import column_statistics

    long = ["x" * 5_000 + str(i % 4) for i in range(20)]
    rows = [(i % 2 or None, float("nan") if i < 3 else -0.0 if i % 2 else 0.0, long[i], None, i % 3 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d string, e boolean")
    got = {r["column_name"]: r for r in column_statistics(df).collect()}
    assert {c: (r["n_unique"], r["n_missing"]) for c, r in got.items()} == {"a": (1, 10), "b": (2, 0), "c": (4, 0), "d": (0, 20), "e": (2, 0)}
    assert got["a"]["samples"] == "1" and got["d"]["samples"] == "" and got["e"]["samples"] == "false|true"
    assert got["c"]["samples"] == "|".join("x" * 5_000 + str(i) for i in range(3))
    assert column_statistics(df.limit(0)).where("n_unique > 0 or samples <> ''").isEmpty()
    # What looks like a stored digest is not taken for one.
    from pyspark.sql import functions as F
    from tabwright.operators.frequencies import cells, short_cells

    pair = spark.createDataFrame([("y" * 99,)], "s string")
    both = pair.unionAll(pair.select(F.concat(F.lit("#"), F.sha2("s", 256)))).unionAll(pair.select(F.sha2("s", 256)))
    assert short_cells(cells(both)).select("s").distinct().count() == 3
