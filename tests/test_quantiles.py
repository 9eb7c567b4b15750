import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def shapes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        hot = 7.0 if rng.random() < 0.4 else rng.gauss(0, 100)
        two = 1.0 if i % 2 else 2.0
        rows.append((rng.random(), hot, float(i % 11), None if i % 3 else rng.gauss(5, 1), 4.0, two, None))
    return spark.createDataFrame(rows, "a double, hot double, few double, holes double, same double, two double, void double")


@pytest.mark.parametrize("sample_rows,bracket_rows", [(100_000, 1_000_000), (300, 100), (50, 5)])
def test_equals_percentile(spark, sample_rows, bracket_rows):
    df = shapes(spark).repartition(3)
    got = exact_quantiles(df, df.columns, PROBS, sample_rows, bracket_rows)
    want = df.agg(*[F.percentile(c, PROBS).alias(c) for c in df.columns]).first().asDict()
    for c in df.columns:
        if want[c] is None:
            assert got[c] == [None] * len(PROBS)
        else:
            assert got[c] == pytest.approx(want[c], abs=1e-9), c


def test_one_row(spark):
    df = spark.createDataFrame([(3,)], "x int")
    assert exact_quantiles(df, ["x"], [0.25, 0.5]) == {"x": [3.0, 3.0]}


def test_nan_is_missing_and_infinity_is_a_value(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (2.0,), (None,), (float("-inf"),)], "x double")
    assert exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]) == {"x": [float("-inf"), 1.5, float("inf")]}
    assert exact_quantiles(df, ["x"], [0.5], sample_rows=2, bracket_rows=1) == {"x": [1.5]}
