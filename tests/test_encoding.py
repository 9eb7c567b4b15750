import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabwright.operators import encoding as E
from tabwright.operators.roles import Target


def test_one_hot_rows_sum_to_one_where_known(small):
    wide = E.one_hot(small.select("row_no", "gender"), ["gender"]).join(small.select("row_no", "gender"), "row_no")
    for r in wide.collect():
        assert r["gender_Female"] + r["gender_Male"] + r["gender_Other"] == (r["gender"] is not None)


def test_scaled_columns(small):
    out = E.standard_scale(small.select("income", "same"), ["income", "same"])
    row = out.agg(F.avg("income").alias("m"), F.stddev_pop("income").alias("s"), F.max("same").alias("z")).first()
    assert abs(row["m"]) < 1e-9 and row["s"] == pytest.approx(1) and row["z"] == 0


def test_text_boolean_pairs_other_words_in_order(small):
    out = E.fit_encoder(small, {"answer": "boolean"}).transform(small.select("row_no", "answer", *small.drop("row_no", "answer").columns))
    got = {(r["row_no"] % 4, r["answer"]) for r in out.collect()}
    assert got == {(0, 1), (1, 0), (2, 0), (3, 1)}


def test_wide_layout_refuses_unbounded_columns(small, monkeypatch):
    with pytest.raises(E.LevelsExceeded):
        E.levels_of(small.withColumn("k", F.col("row_no").cast("string")), ["k"], limit=50)


def test_quotes_in_values_and_names(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), (None,)], "`odd name` string")
    out = E.one_hot(df, ["odd name"]).collect()
    assert sorted(map(tuple, out)) == [(0, 0), (0, 1), (1, 0)]


def test_tfidf_equals_a_plain_computation(spark):
    texts = ["the red cat sat", "a red dog ran home", None, "cat cat dog été", "red"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    stop = set(E.english_stop_words())
    rows = [[w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in stop] for t in texts]
    total = Counter(w for r in rows for w in r)
    vocabulary = sorted(sorted(total, key=lambda w: (-total[w], w))[:3])
    idf = {w: math.log((1 + len(rows)) / (1 + sum(w in r for r in rows))) + 1 for w in vocabulary}
    got = {r["id"]: [r[f"t_tfidf_{i}"] for i in range(3)] for r in E.tfidf(df, "t", terms=3).collect()}
    for i, words in enumerate(rows):
        raw = [words.count(w) * idf[w] for w in vocabulary]
        norm = math.sqrt(sum(x * x for x in raw)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in raw])


def test_saved_encoder_gives_the_same_rows(spark, small, tmp_path):
    roles = {"income": "numeric-continuous", "gender": "categorical-ordinal", "answer": "categorical-nominal", "row_no": "identifier_ignore", "seen": "datetime"}
    enc = E.fit_encoder(small, roles, Target("purchased", "classification", "binary_01"))
    enc.to_params(spark).write.parquet(str(tmp_path / "p"))
    back = E.Encoder.from_params(spark.read.parquet(str(tmp_path / "p")))
    assert back.transform(small).exceptAll(enc.transform(small)).count() == 0
    out = enc.transform(small)
    assert "row_no" not in out.columns and {"seen_year", "answer_maybe"} <= set(out.columns)
    assert dict(out.dtypes)["gender"] == "int" and out.where("gender = -1").count() == small.where("gender is null").count()
    pairs = enc.column_mapping(small, "purchased")
    assert ("answer", "answer_yes") in pairs and ("income", "income") in pairs


def test_unseen_value_is_all_zeros(spark, small):
    enc = E.fit_encoder(small, {"gender": "categorical-nominal"})
    new = spark.createDataFrame([("Unknown",)], "gender string")
    assert set(enc.transform(new).first()) == {0}


def test_encoder_comparison_equals_row_correlations(small):
    df = small.select("gender", "income").dropna()
    got = E.encoder_comparison(df, "gender", "income").first()
    encoded = E.target_mean_encode(df, "gender", "income", "m")
    assert got["target_encoding_r"] == pytest.approx(abs(encoded.agg(F.corr("m", "income")).first()[0]))
    levels = [abs(df.agg(F.corr((F.col("gender") == v).cast("int"), "income")).first()[0]) for v in ("Female", "Male", "Other")]
    assert got["best_one_hot_r"] == pytest.approx(max(levels))


def test_many_ordinal_levels(spark):
    values = [f"v{i * 7 % 100}" for i in range(100)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "k string")
    order = {v: i for i, v in enumerate(sorted(set(values) - {None}))}
    for wide_levels in (0, 2_000):
        enc = E.fit_encoder(df, {"k": "categorical-ordinal"}, wide_levels=wide_levels)
        assert Counter(r["k"] for r in enc.transform(df).collect()) == Counter(order.get(v, -1) for v in values)


def test_long_one_hot_takes_any_number_of_values(spark):
    df = spark.range(6_000).selectExpr("id", "CASE WHEN id > 5 THEN id % 2500 END AS k", "id * 0.5D AS x")
    assert dict(E.one_hot(df, ["k"]).dtypes)["k"] == "vector"
    want = {i: (i % 2500, str(i % 2500)) for i in range(6, 6_000)}
    rows = E.one_hot_rows(df, ["id"], "k").collect()
    assert len(rows) == len(want) and {r["id"]: (r["position"], r["value"]) for r in rows} == want and {r["hot"] for r in rows} == {1}
    assert {r["id"]: r["hot"] for r in E.one_hot_rows(df, ["id"], "k", "x").collect()} == {i: i / 2 for i in want}


@pytest.mark.parametrize("size", [1_999, 2_001, 300_000])
def test_the_same_features_at_any_number_of_values(spark, size):
    """One 0/1 feature for each value in sorted order, whether as columns or as a vector."""
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(size + 50).selectExpr("id", "lpad(CAST(id % {n} AS STRING), 6, '0') AS k".format(n=size), "CAST(id AS DOUBLE) AS x")
    enc = E.fit_encoder(df, {"k": "categorical-nominal"})
    kind = {s.column: s.kind for s in enc.steps}["k"]
    assert kind == ("one_hot" if size < 2_000 else "hot_vector")
    new = spark.createDataFrame([(7, "000007", 1.0), (8, None, 1.0), (9, "unseen", 1.0)], df.schema)
    features = VectorAssembler(inputCols=[c for c in enc.transform(new).columns if c not in ("id", "x")], outputCol="f")
    got = {r["id"]: r["f"] for r in features.transform(enc.transform(new)).collect()}
    assert all(v.size == size for v in got.values())
    assert {i: [j for j in range(size) if v[j]] if size < 5_000 else list(v.indices) for i, v in got.items()} == {7: [7], 8: [], 9: []}
    if size > 5_000:
        assert enc.transform(df).where("k IS NULL").count() == 0


def test_wide_columns_in_a_saved_pipeline(spark, tmp_path):
    """Fit, save, load and score with a category of 2,500 values; the flow compares and explains with it."""
    from pyspark.ml import PipelineModel
    from pyspark.ml import regression as R

    from tabwright.operators import explaining, training

    df = spark.range(6_000).selectExpr("id", "CAST(id % 2500 AS STRING) AS k", "CAST(id % 2500 AS DOUBLE) + id % 2 AS y")
    enc = E.fit_encoder(df, {"k": "categorical-nominal"})
    model = training.finalize(R.LinearRegression(regParam=0.001), df, "y", ["id"], stages=[enc.as_stage(df)])
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    a, b = ({r["id"]: r["prediction"] for r in m.transform(df).collect()} for m in (model, back))
    assert a == b and max(abs(a[i] - (i % 2500)) for i in a) < 30
    board = training.compare_models(enc.transform(df), "y", "regression", ["id"], models={"linear": R.LinearRegression(regParam=0.001)})
    assert board.first()["r2"] > 0.7  # a value whose rows are all held out is unknown
    assert [r["feature"] for r in explaining.grouped_importance(model, enc.transform(df)).collect()] == ["k"]
    params = E.Encoder.from_params(enc.to_params(spark))
    assert params.transform(df).exceptAll(enc.transform(df)).count() == 0
