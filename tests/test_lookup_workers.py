"""Lookups join the stored parameters themselves, not rows that went through the driver's Python."""

import pytest
from pyspark.sql import SparkSession, functions as F

from tabwright.functions.sizing import lookup


@pytest.mark.parametrize("limit", [100, 2])
def test_lookup_starts_no_python_workers(spark, limit, monkeypatch):
    """Rows from the driver are unpickled by Python workers, which then stay beside those of other stages."""
    rows = spark.range(60).select((F.col("id") % 6).alias("k"), "id")
    params = spark.range(5).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") * 10).alias("v"), F.lit(9).cast("long").alias("n"))
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda *a, **k: pytest.fail("rows from the driver"))
    for weight in (None, "n"):
        found = lookup(rows, params, "k", weight=weight, limit=limit)
        got = {(r["k"], r["v"]): r["n_rows"] for r in found.groupBy("k", "v").agg(F.count("*").alias("n_rows")).collect()}
        assert got == {(k, k * 10 if 0 < k < 5 else None): 10 for k in range(6)}
