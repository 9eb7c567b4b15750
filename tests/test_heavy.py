"""Heavy values against plain counting, with buckets so few that values collide."""

from collections import Counter

import pytest

from tabwright.operators import frequencies as Q, heavy
from pyspark.sql import functions as F


def values(n=3000):
    """Zipf-like counts with ties at every level, a NULL and values that occur once."""
    out = []
    for i in range(1, 200):
        out += [f"v{i}"] * (n // (i * i) + 1)
    return out + [None] * 40 + ["ü"] * 7


def top(found, k):
    counts = Counter(found)
    floor = sorted(counts.values(), reverse=True)[min(k, len(counts)) - 1]
    return {v: n for v, n in counts.items() if n >= floor}


@pytest.mark.parametrize("k,buckets,first", [(5, 65_536, 256), (5, 7, 1), (40, 16, 2), (500, 16, 3), (1, 1, 1)])
def test_equals_counting_everything(spark, k, buckets, first):
    rows = values()
    df = spark.createDataFrame([(v,) for v in rows], "v string").repartition(3)
    got = heavy.heavy_values(df, ["v"], k, buckets=buckets, first=first)
    assert got.columns == ["v", "n"] and {r["v"]: r["n"] for r in got.collect()} == top(rows, k)


def test_weights_groups_and_further_sums(spark):
    rows = [("a", v, 1 if i % 2 else 0) for i, v in enumerate(values(300))] + [(None, "x", 1), (None, "y", 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "g string, v string, w bigint")
    got = heavy.heavy_values(df, ["v"], 3, ["g"], F.col("w"), {"all": F.count(F.lit(1))}, buckets=8, first=2)
    found = {(r["g"], r["v"]): (r["n"], r["all"]) for r in got.collect()}
    weighed, every = Counter(), Counter()
    for g, v, w in rows:
        weighed[g, v] += w
        every[g, v] += 1
    floor = sorted((n for (g, _), n in weighed.items() if g == "a"), reverse=True)[2]
    assert found == {key: (n, every[key]) for key, n in weighed.items() if n and (key[0] is None or n >= floor)}


@pytest.mark.parametrize("sizes", [{}, {"buckets": 5, "first": 1}])
def test_modes_as_from_all_frequencies(spark, small, sizes):
    assert sorted(map(str, heavy.column_modes(small, **sizes).collect())) == sorted(map(str, Q.modes(Q.value_frequencies(small)).collect()))
    assert heavy.column_modes(small.limit(0)).collect() == []
