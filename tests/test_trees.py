"""Tree attribution against sums over all subsets, for trees, forests and boosted trees."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import training as T, tree_attribution as A

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(300):
        a, b, c, d = rng.random(), rng.gauss(0, 1), float(rng.randrange(4)), rng.random()
        out.append((i, a, b, c, d, a * c + (b > 0.3) - d * (c == 2), int(a + b > 0.6), int(c) % 3))
    return spark.createDataFrame(out, "id int, a double, b double, c double, d double, y double, label int, kind int").cache()


def by_subsets(x, leaves, outputs):
    """Shapley values by listing all coalitions."""
    n = len(x)

    def known(s):
        total = np.zeros(outputs)
        for leaf in leaves:
            total = total + leaf.value * np.prod([
                float(c.met(np.array([x[j]]))[0]) if j in s else c.share for j, c in leaf.path.items()
            ])
        return total

    phi = np.zeros((n, outputs))
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for size in range(n):
            for s in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                phi[i] += weight * (known({*s, i}) - known(set(s)))
    return phi


# Made when a test runs: an estimator needs a session.
MODELS = [
    (lambda: R.DecisionTreeRegressor(maxDepth=4), "y", 0), (lambda: R.RandomForestRegressor(numTrees=4, maxDepth=4, seed=1), "y", 0), (lambda: R.GBTRegressor(maxIter=4, maxDepth=3, seed=1), "y", 0),
    (lambda: C.DecisionTreeClassifier(maxDepth=4), "label", 2), (lambda: C.RandomForestClassifier(numTrees=3, maxDepth=3, seed=1), "kind", 3), (lambda: C.GBTClassifier(maxIter=3, maxDepth=3, seed=1), "label", 2),
]


@pytest.mark.parametrize("estimator, target, classes", MODELS)
def test_equals_subsets_and_adds_up(rows, estimator, target, classes):
    data = rows.select("id", *FEATURES, target)
    model = T.finalize(estimator(), data, target, ["id"])
    leaves = A.leaves_of(model, classes)
    outputs = len(leaves[0].value)
    found = {(r["id"], r["feature"]): np.atleast_1d(r["phi"]) for r in A.tree_attribution(model, data, ["id"], classes).collect()}
    assert len(found) == 300 * 4
    for r in data.limit(12).collect():
        want = by_subsets([r[c] for c in FEATURES], leaves, outputs)
        for j, c in enumerate(FEATURES):
            assert found[r["id"], c] == pytest.approx(want[j], abs=1e-9)
    last = type(model.stages[-1]).__name__
    if last.startswith("GBTClass"):
        output = F.array(vector_to_array(F.col("rawPrediction"))[1])
    elif classes:
        p = vector_to_array(F.col("probability"))
        output = F.array(p[1]) if classes == 2 else p
    else:
        output = F.array("prediction")
    base = A.base_value(leaves)
    for r in model.transform(data).select("id", output.alias("o")).collect():
        assert np.array(r["o"]) == pytest.approx(base + sum(found[r["id"], c] for c in FEATURES), abs=1e-9)


def test_missing_values_go_right_and_stumps_have_no_leaf_path(spark, rows):
    data = rows.select("id", *FEATURES, "y")
    model = T.finalize(R.DecisionTreeRegressor(maxDepth=3), data, "y", ["id"])
    holed = spark.createDataFrame([(1, None, 0.1, 2.0, 0.5)], "id int, a double, b double, c double, d double")
    total = A.tree_attribution(model, holed, ["id"]).agg(F.sum("phi")).first()[0]
    want = model.transform(holed.fillna(float("nan"))).first()["prediction"]
    assert total + A.base_value(A.leaves_of(model))[0] == pytest.approx(want)
    flat = T.finalize(R.DecisionTreeRegressor(), data.withColumn("y", F.lit(2.0)), "y", ["id"])
    assert {r["phi"] for r in A.tree_attribution(flat, data, ["id"]).collect()} == {0.0}
