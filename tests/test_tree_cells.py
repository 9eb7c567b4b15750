"""Single and boosted regression trees of many rows are fitted on cells, and are the trees of the rows."""

import pytest
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from tabwright.operators import training as T


def models():
    return {
        "decision_tree": R.DecisionTreeRegressor(seed=123),
        "boosted_trees": R.GBTRegressor(seed=123, maxIter=3, maxDepth=3),
        "random_forest": R.RandomForestRegressor(seed=123, numTrees=3, maxDepth=2),
    }


def rows(spark):
    n = spark.range(0, 4_000, 1, 2)
    a, b = F.pmod(F.xxhash64("id"), F.lit(11)), F.pmod(F.hash("id"), F.lit(7)) / 4
    return n.select("id", a.cast("int").alias("a"), b.alias("b"), (a * b + a + F.pmod(F.col("id"), F.lit(5)) / 7).alias("y"))


def board(spark):
    return {r["model"]: r for r in T.compare_models(rows(spark), "y", "regression", ["id"], models=models()).collect()}


def test_trees_on_cells_are_those_on_rows(spark, monkeypatch):
    plain, used, kept = board(spark), [], T.fold_cells
    monkeypatch.setattr(T, "CELL_ROWS", 1_000)
    monkeypatch.setattr(T, "fold_cells", lambda *a: used.append(kept(*a)) or used[-1])
    found = board(spark)
    assert [n for _, _, n in used[0].values()] == [77] * 5  # fitted on 77 cells, not on 3,200 rows
    for name, row in plain.items():
        assert found[name]["error"] is None and row["error"] is None
        assert [found[name][m] for m in T.REGRESSION_METRICS] == pytest.approx([row[m] for m in T.REGRESSION_METRICS], rel=1e-9)


def test_rows_are_used_where_cells_would_not_do(spark):
    assert not T.fits_on_cells(R.RandomForestRegressor()) and not T.fits_on_cells(R.GBTRegressor(subsamplingRate=0.5))
    assert not T.fits_on_cells(R.DecisionTreeRegressor(minInstancesPerNode=3)) and T.fits_on_cells(R.DecisionTreeRegressor())
    data = rows(spark).withColumn("__fold", T.fold_of(["id"], 2))
    assert T.fold_cells(data.withColumn("a", F.when(F.col("id") > 5, F.col("a"))), "y", ["a", "b"], 2, 32) == {}
    assert T.fold_cells(data, "y", ["id", "a", "b"], 2, 32) == {}  # as many cells as rows
