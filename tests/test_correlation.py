"""All pairs from one scan, against numpy."""

import random

import numpy as np
import pytest

from tabwright.operators import correlation as C


def table(spark, width, rows=120):
    rng = random.Random(width)
    data = []
    for _ in range(rows):
        base = [rng.gauss(0, 1) * 10 ** (i % 5) + 1e6 * (i % 3) for i in range(width)]
        for i in range(1, width, 4):
            base[i] = base[i - 1] * 2 + rng.gauss(0, 0.2) * 10 ** (i % 5)
        base[-1] = 5.0
        data.append([None if (i % 7 == 3 and rng.random() < 0.2) else v for i, v in enumerate(base)])
    return data, spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(width)))


@pytest.mark.parametrize("widest", [2_000, 60])
def test_many_columns(spark, monkeypatch, widest):
    monkeypatch.setattr(C, "WIDEST", widest)
    width = 500 if widest == 2_000 else 130
    data, df = table(spark, width)
    x = np.array(data, float)
    want = {}
    for i in range(width):
        for j in range(i + 1, width):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if a.std() > 0 and b.std() > 0:
                r = abs(np.corrcoef(a, b)[0, 1])
                if r > 0.9:
                    want[f"c{i}", f"c{j}"] = r
    got = {(r["left_column"], r["right_column"]): r["abs_r"] for r in C.correlated_pairs(df, 0.9).collect()}
    assert got == pytest.approx(want, abs=1e-9) and want


def test_no_rows_and_one_row(spark):
    _, df = table(spark, 6)
    assert C.correlated_pairs(df.limit(0)).count() == 0 and C.correlated_pairs(df.limit(1)).count() == 0
