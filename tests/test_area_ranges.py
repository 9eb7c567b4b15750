"""Areas under curves from score ranges, against counting all pairs."""

import random

import pytest

from tabwright.operators import metrics as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(rows):
    """Wins of positives over negatives, ties half; a missing score is below all, NaN above."""
    place = lambda s: (-1, 0) if s is None else (1, 0) if s != s else (0, s)
    p, q = ([place(s) for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)) if p and q else None


@pytest.mark.parametrize("range_rows", [40, 10**6])
def test_areas_by_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(M, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(M, "RUN_ROWS", 64)
    rng = random.Random(3)
    pick = lambda: rng.choice([None, float("nan"), -0.0, 0.0, 0.25, rng.random(), rng.random()])
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), pick(), rng.choice([0, 1, 1, None])) for _ in range(700)] + [("only", 0, 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, h int, s double, y int").repartition(3)
    out = M.auc_by(df, ["g", "h"], "y", "s")
    assert "FlatMapGroupsInArrow" in plan(out) and "rangepartitioning" not in plan(out)
    got = {(r["g"], r["h"]): r["auc"] for r in out.collect()}
    assert got.keys() == {r[:2] for r in rows}
    for key, area in got.items():
        want = brute([r[2:] for r in rows if r[:2] == key])
        assert area is None if want is None else area == pytest.approx(want, abs=1e-12)
