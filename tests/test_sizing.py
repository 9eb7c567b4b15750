from pyspark.sql import functions as F

from tabwright.functions.sizing import lookup, numbered, rows_if_bounded
from tabwright.operators.importance import label_codes
from tabwright.operators import importance


def facts(spark):
    """A third of all rows share one key; some keys are missing or NULL."""
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k")
    )


def test_lookup_gives_the_same_rows_by_broadcast_and_by_shuffle(spark):
    df = facts(spark)
    params = df.where("k is not null and k <> 'k7'").groupBy("k").agg(F.avg("id").alias("m"), F.max("id").alias("top"), F.count("*").alias("n"))
    want = {r["id"]: (r["m"], r["top"]) for r in df.join(params, "k", "left").collect()}
    for limit in (10_000, 5):
        for weight in ("n", None):
            got = lookup(df, params, "k", weight=weight, limit=limit)
            assert set(got.columns) - {"n"} == {"id", "k", "m", "top"}
            rows = got.collect()
            assert len(rows) == 3000
            assert {r["id"]: (r["m"], r["top"]) for r in rows} == want


def test_numbered_is_a_dense_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.lit("a").alias("y")).repartition(5)
    rows = numbered(df, ["x"], "at").collect()
    assert sorted((r["x"], r["at"]) for r in rows) == [(i, i) for i in range(1000)]


def test_label_codes_do_not_depend_on_the_path(spark, monkeypatch):
    df = facts(spark)
    few = {r["value"]: r["code"] for r in label_codes(df, "k").collect()}
    monkeypatch.setattr(importance, "DRIVER_ROWS", 3)
    many = {r["value"]: r["code"] for r in label_codes(df, "k").collect()}
    assert few == many == {v: i for i, v in enumerate(sorted(few))}


def test_rows_if_bounded(spark):
    assert len(rows_if_bounded(spark.range(5), 5)) == 5
    assert rows_if_bounded(spark.range(6), 5) is None
