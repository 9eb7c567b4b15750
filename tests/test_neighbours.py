"""Nearest-neighbour mutual information against a brute force over all pairs of rows."""

import math

import pytest
from pyspark.sql import functions as F

from tabwright.operators import importance as I, neighbours as N, roles as R

TARGET = R.Target("y", "classification", "multiclass_text_labels")


def psi(m):
    return sum(1 / i for i in range(1, m)) - 0.5772156649015329


def brute(rows, k):
    """rows: (x, y)."""
    size = {y: sum(1 for _, other in rows if other == y) for _, y in rows}
    kept = [(x, y) for x, y in rows if size[y] > 1]
    if not kept:
        return 0.0
    total = 0.0
    for i, (x, y) in enumerate(kept):
        far = sorted(abs(x - v) for j, (v, c) in enumerate(kept) if c == y and j != i)
        r = far[min(k, size[y] - 1) - 1]
        near = [c for v, c in kept if v == x or abs(v - x) < r - 1e-9]
        total += psi(sum(c == y for c in near)) - psi(size[y]) - psi(len(near))
    return max(0.0, psi(len(kept)) + total / len(kept))


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(150):
        y = "abc"[i % 3] if i else "alone"
        out.append((
            (i % 3) * 40.0 + (i * 37 % 101) / 3, i % 5, 7, float(i * 7919 % 150), ["u", "v", "w", None][(i + i % 3) % 4],
            (i * 31 % 17) / 10 if i % 2 else 0.3, y,
        ))
    return out


SCHEMA = "apart double, few int, same int, noise double, word string, hot double, y string"


@pytest.mark.parametrize("k,block", [(3, 50_000), (3, 3), (1, 2), (5, 7)])
def test_equals_all_pairs_for_any_block(spark, rows, k, block):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["column_name"]: r["mi"] for r in N.neighbour_mutual_info(df, TARGET, k, block).collect()}
    words = sorted({r[4] or "Missing" for r in rows} | {None}, key=str)
    clean = I.stable_clean(df, "y").collect()
    codes = {w: i for i, w in enumerate(sorted({r["word"] for r in clean}))}
    assert set(got) == {"apart", "few", "same", "noise", "word", "hot"} and len(words) > 3
    for c, mi in got.items():
        pairs = [(float(codes[r[c]] if c == "word" else r[c]), r["y"]) for r in clean]
        assert mi == pytest.approx(brute(pairs, k), abs=1e-8), c
    assert got["apart"] > 0.8 and got["same"] == 0.0


def test_classes_of_one_row_each_and_empty_tables_score_nothing(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    assert [tuple(r) for r in N.neighbour_mutual_info(df, TARGET).collect()] == [("x", 0.0)]
    assert N.neighbour_mutual_info(df.limit(0), TARGET).collect() == []


def test_a_block_must_hold_the_neighbours(spark):
    points = spark.createDataFrame([("x", "a", 1.0, 1)], "column_name string, y string, x double, n bigint")
    with pytest.raises(ValueError):
        N.neighbourhoods(points, 3, 2)


def test_digamma(spark):
    for r in spark.range(1, 60).select("id", N.digamma(F.col("id")).alias("v")).collect():
        assert r["v"] == pytest.approx(psi(r["id"]), abs=1e-10)
    big = spark.range(1).select(N.digamma(F.lit(10**9)).alias("v")).first()["v"]
    assert big == pytest.approx(math.log(10**9) - 0.5e-9, abs=1e-12)


def test_key_features_take_the_scorer_asked_for(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).drop("hot", "word")
    assert I.key_features(df, TARGET, 1, N.neighbour_mutual_info) == ["apart"]
