import datetime as dt

from pyspark.sql import functions as F

from tabwright.operators import cleaning, cleaning as C
from tabwright.operators.frequencies import modes, value_frequencies
from tabwright.operators.roles import Target

ROLES = {"customer_age": "numeric-discrete", "income": "numeric-continuous", "gender": "categorical-nominal", "answer": "categorical-nominal", "void": "numeric-continuous"}


def test_no_holes_after_cleaning_and_rows_kept(spark, small):
    df = small.drop("seen")
    out = cleaning.clean(df, ROLES)
    assert out.count() == df.count()
    assert out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first().asDict() == dict.fromkeys(out.columns, 0)
    assert {r["void"] for r in out.collect()} == {0.0}


def test_imputing_can_create_duplicates_that_are_removed(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0)], "k string, x double")
    out = cleaning.clean(df, {"x": "numeric-continuous"})
    assert sorted(map(tuple, out.collect())) == [("a", 1.0), ("b", 1.0)]
    audit = {(r["step"], r["column_name"]): r["n_affected"] for r in cleaning.cleaning_audit(df, {"x": "numeric-continuous"}).collect()}
    assert audit == {("impute", "x"): 1, ("deduplicate", ""): 1}


def test_ties_of_the_mode_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "k string")
    assert modes(value_frequencies(df)).first()["s"] == "a"


def test_all_null_columns_take_their_placeholder(spark):
    df = spark.createDataFrame([(1, None, None, None)], "id int, t string, f boolean, d date")
    out = cleaning.clean(df, {"t": "text", "f": "boolean", "d": "datetime"}, order=["id"]).first()
    assert out["t"] == "_UNKNOWN_" and out["f"] is False and out["d"] == dt.date(1900, 1, 1)


def test_neighbour_fill_equals_a_loop(spark):
    days = [None, None, 5, None, None, None, 9, None, 2, None] * 12 + [None] * 30
    rows = [(i // 4, i, None if v is None else dt.date(2024, 1, v)) for i, v in enumerate(days)]
    df = spark.createDataFrame(rows, "t int, id int, d date").repartition(7)
    got = {r["id"]: r["d"] for r in cleaning.fill_from_neighbours(df, "d", ["t", "id"]).collect()}
    want, last = {}, None
    for _, i, d in rows:
        last = d or last
        want[i] = last
    first = next(d for _, _, d in rows if d)
    assert got == {i: d or first for i, d in want.items()}


def test_target_role():
    assert cleaning.target_role(Target("t", "classification", "binary_01")) == "numeric-continuous"
    assert cleaning.target_role(Target("t", "classification", "multiclass_int_labels")) == "categorical-ordinal"
    assert cleaning.target_role(Target("t", "classification", "unknown_type")) == "categorical-nominal"


def test_digests_tell_rows_apart(spark, monkeypatch):
    """NULLs by place, NaN, signed zeros; rows that share a digest are compared whole; many repeats go another way."""
    from tabwright.functions import digests as D
    from tabwright.operators import profiling as P

    nan = float("nan")
    rows = [("a", None, 0.0), (None, "a", 0.0), ("a", None, -0.0), ("b", "b", nan), ("b", "b", -nan), ("", None, 1.0), (None, "", 1.0), ("b", "b", None), ("b", "b", None)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    want = df.distinct().count()
    assert C.drop_duplicates(df).count() == want == 6
    assert tuple(P.duplicate_rows(df).first()) == (9, 6, 3)
    assert C.drop_duplicates(df.limit(0)).count() == 0 and tuple(P.duplicate_rows(df.limit(0)).first()) == (0, 0, 0)
    single = df.distinct()
    assert C.drop_duplicates(single).exceptAll(single).count() == 0
    many = spark.range(600).selectExpr("id % 200 AS k", "CAST(id % 7 AS STRING) AS s")
    distinct = many.distinct().count()
    with monkeypatch.context() as m:
        m.setattr(D, "DRIVER_ROWS", 10)
        assert C.drop_duplicates(many).count() == distinct and P.duplicate_rows(many).first()["distinct_rows"] == distinct
    from pyspark.sql import functions as F

    with monkeypatch.context() as m:
        m.setattr(D, "row_digest", lambda d, columns=None: [F.lit(1).cast("long").alias("__h1"), F.pmod(F.hash(*d.columns), F.lit(3)).cast("long").alias("__h2")])
        assert C.drop_duplicates(many).count() == distinct and P.duplicate_rows(many).first()["distinct_rows"] == distinct
