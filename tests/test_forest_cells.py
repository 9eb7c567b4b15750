"""Forests of many rows are grown on cells of drawn rows; bins, draws and scores of cells are those of the rows."""

import numpy as np
import pytest
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from tabwright.operators import cells, closed_form as closed, metrics as M, training as T


def rows(spark, n=4_000):
    a, b = F.pmod(F.xxhash64("id"), F.lit(11)), F.pmod(F.hash("id"), F.lit(7)) / 4
    return spark.range(0, n, 1, 2).select("id", a.cast("int").alias("a"), b.alias("b"), (a * b + a + F.pmod(F.col("id"), F.lit(5)) / 7).alias("y"))


def board(data, models):
    return {r["model"]: r for r in T.compare_models(data, "y", "regression", ["id"], models=models).collect()}


def test_forests_of_many_rows_are_grown_on_cells(spark, monkeypatch):
    models = {
        "forest": R.RandomForestRegressor(seed=1, numTrees=7, maxDepth=3, featureSubsetStrategy="all"),
        "tree": R.DecisionTreeRegressor(maxDepth=3),
    }
    plain, used, kept = board(rows(spark), models), [], T.tree_of_forest
    monkeypatch.setattr(T, "CELL_ROWS", 1_000)
    monkeypatch.setattr(T, "DRAWN_ROWS", 1_000)
    monkeypatch.setattr(T, "tree_of_forest", lambda *a: used.append(a[3].count()) or kept(*a))
    found = board(rows(spark), models)
    assert used == [77] * 7 * 5  # every tree of every fold on 77 cells, not on 3,200 rows
    assert found["forest"]["error"] is None and found["forest"]["folds_done"] == 5
    assert found["forest"]["r2"] == pytest.approx(plain["forest"]["r2"], abs=0.02)  # other draws
    assert found["forest"]["r2"] != found["tree"]["r2"]
    assert [found["tree"][m] for m in T.REGRESSION_METRICS] == pytest.approx([plain["tree"][m] for m in T.REGRESSION_METRICS], rel=1e-9)


def test_forests_that_need_rows_are_left_on_them(spark, monkeypatch):
    assert T.draws_on_cells(R.RandomForestRegressor()) and T.draws_on_cells(R.RandomForestRegressor(subsamplingRate=0.5))
    assert not T.draws_on_cells(R.RandomForestRegressor(minInstancesPerNode=2)) and not T.draws_on_cells(R.RandomForestRegressor(bootstrap=False))
    models = {"forest": R.RandomForestRegressor(seed=1, numTrees=60, maxDepth=1), "tree": R.DecisionTreeRegressor(maxDepth=1)}
    plain = board(rows(spark), models)
    monkeypatch.setattr(T, "CELL_ROWS", 1_000)
    monkeypatch.setattr(T, "DRAWN_ROWS", 1_000)  # draws of 60 trees would hold more numbers than 4,000 rows
    found = board(rows(spark), models)
    for name in models:
        assert [found[name][m] for m in T.REGRESSION_METRICS] == pytest.approx([plain[name][m] for m in T.REGRESSION_METRICS], rel=1e-9)


def test_draws_are_poisson_for_every_row_and_tree(spark):
    data = spark.range(0, 40_000, 1, 4).select((F.col("id") % 400).alias("code"), (F.col("id") / 40_000).alias("y"))
    tables = cells.drawn_sums(data, [(3, 6, 1.0), (3, 1, 0.5)])
    assert [t.columns for t in tables] == [["code", *[f"{c}{t}" for t in some for c in "ws"]] for some in (range(5), range(5, 7))]
    got = tables[0].join(tables[1], "code").toPandas()
    for t in range(7):
        mean, w = 100 if t < 6 else 50, got[f"w{t}"].to_numpy()
        assert len(w) == 400 and abs(w.mean() - mean) < 3 and 0.8 < w.var() / mean < 1.25
        assert (w == np.rint(w)).all()
        assert 0.45 < got[f"s{t}"].sum() / w.sum() < 0.55
    assert abs(np.corrcoef(got["w0"], got["w1"])[0, 1]) < 0.2 and abs(np.corrcoef(got["w0"], got["w6"])[0, 1]) < 0.2


def test_cuts_are_of_equal_count_outside_the_fold(spark):
    values = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7
    data = spark.range(0, 20_000, 1, 3).select((F.col("id") % 2).cast("int").alias("__fold"), "id", F.when(F.col("id") % 2 == 0, values).otherwise(values * 3).alias("v"), F.lit(4).alias("one"), (F.col("id") % 5).alias("few"))
    count, cuts = cells.fold_cuts(data, ["v", "one", "few"], 2, 8)
    assert count == 20_000 and [c[1].tolist() for c in cuts] == [[], []] and [c[2].tolist() for c in cuts] == [[1, 2, 3, 4]] * 2
    table = data.toPandas()
    for k in range(2):
        outside = table[table["__fold"] != k]["v"].to_numpy()
        assert np.bincount(np.searchsorted(cuts[k][0], outside, side="right"), minlength=8) == pytest.approx([1_250] * 8, abs=120)
    edges = [np.unique(np.concatenate(c)) for c in zip(*cuts)]
    coded = cells.coded(data.withColumn("y", F.col("id")), "y", ["v", "one", "few"], edges, 2)
    for k in range(2):
        bins = coded.select("y", (F.col("code") % 2).alias("fold"), *[b.alias(f"b{i}") for i, b in enumerate(cells.bins_of(edges, cuts[k], 2))]).toPandas().sort_values("y")
        assert (bins["fold"].to_numpy() == table.sort_values("id")["__fold"].to_numpy()).all()
        for i, c in enumerate(["v", "one", "few"]):
            assert (bins[f"b{i}"].to_numpy() == np.searchsorted(cuts[k][i], table.sort_values("id")[c].to_numpy(), side="right")).all()
    assert cells.fold_cuts(data.withColumn("few", F.when(F.col("id") > 3, F.col("few"))), ["v", "few"], 2, 8) is None


def test_a_forest_of_trees_predicts_their_mean(spark):
    data = T.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows(spark, 500))
    trees = [R.RandomForestRegressor(seed=s, numTrees=1, maxDepth=3, labelCol="y").fit(data) for s in range(3)]
    whole = {r["id"]: r["prediction"] for r in T.forest_of(trees).transform(data).collect()}
    each = [{r["id"]: r["prediction"] for r in t.transform(data).collect()} for t in trees]
    assert all(whole[i] == pytest.approx(sum(e[i] for e in each) / 3) for i in whole)


def test_sums_and_scores_of_few_columns_are_those_of_many(spark, monkeypatch):
    data = rows(spark, 3_000)
    models = {"linear": R.LinearRegression(), "lasso": R.LinearRegression(regParam=0.1, elasticNetParam=1.0)}
    holes = data.withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    few, broken = board(data, models), []
    for most in (closed.FEW_COLUMNS, 0):
        monkeypatch.setattr(closed, "FEW_COLUMNS", most)
        with pytest.raises(RuntimeError) as problem:
            board(holes, models)
        broken.append(str(problem.value))
    assert broken[0] == broken[1] and "holds nulls" in broken[0]
    many = board(data, models)
    for name in models:
        assert [few[name][m] for m in T.REGRESSION_METRICS] == pytest.approx([many[name][m] for m in T.REGRESSION_METRICS], rel=1e-9)
    scored = data.select((F.col("id") % 3).alias("k"), "y", (F.col("a") * 1.5).alias("p"), F.when(F.col("id") > 9, F.col("b")).alias("q"))
    wide = {r["k"]: r for r in M.regression_scores_wide(scored, ["k"], "y", ["p", "q"]).collect()}
    for p in ("p", "q"):
        for r in M.regression_scores(scored, ["k"], "y", p).collect():
            assert wide[r["k"]][p].asDict() == pytest.approx({c: r[c] for c in r.asDict() if c != "k"})
