"""Kernel attribution in tasks of bounded size."""

import pytest
from pyspark.ml.feature import SQLTransformer

from tabwright.functions.sizing import parted
from tabwright.operators import explaining as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kernel_rows_are_shuffled_once_in_tasks_of_bounded_size(spark):
    rows = spark.range(50).selectExpr("id", "id * 1.0 AS a", "id % 7 * 1.0 AS b", "id AS k")
    tasks = parted(rows, ["id", "k"], 2_000_000)
    assert tasks.rdd.getNumPartitions() == 10
    rule = SQLTransformer(statement="SELECT *, a * b AS prediction FROM __THIS__")
    phi = X.kernel_attribution(rule, tasks.distinct(), ["id", "k"], ["a", "b"], background=[[1.0, 2.0]], is_parted=True)
    assert plan(phi).count("Exchange") == 1
    plain = X.kernel_attribution(rule, rows, ["id", "k"], ["a", "b"], background=[[1.0, 2.0]])
    assert plan(plain).count("Exchange") == 1
    key = lambda r: (r["id"], r["feature"])
    got = sorted(phi.collect(), key=key)
    assert got == sorted(plain.collect(), key=key)
    for r in got:
        a, b = float(r["id"]), float(r["id"] % 7)
        want = (a - 1) * (b + 2) / 2 if r["feature"] == "a" else (b - 2) * (a + 1) / 2
        assert r["phi"] == pytest.approx(want)
