import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabwright.plans import flow
from tabwright.sources import tables


def test_csv_types_and_refusals(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("age,income,day,name\n1,2.5,2024-01-02,a\n,nan,2024-01-03,\n")
    df = tables.scan_csv(spark, str(path))
    assert dict(df.dtypes) == {"age": "int", "income": "double", "day": "string", "name": "string"}
    assert df.where("income is null").count() == 1
    (tmp_path / "empty.csv").write_text("age,income\n")
    with pytest.raises(tables.EmptyTable):
        tables.scan_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "bad.csv").write_text("age,income\n1,2\n1,2,3,4\n")
    with pytest.raises(Exception):
        tables.scan_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_whole_flow(spark, tmp_path):
    rows = [(i, 20 + i * 7 % 50, 1000.0 + (i * 37) % 500 if i % 9 else None, ("Female", "Male", "Other")[i % 3], int((i * 37) % 500 > 250)) for i in range(150)]
    df = spark.createDataFrame(rows, "row_no bigint, age int, income double, gender string, purchased int")
    out = flow.run_table(df, ["row_no"], "purchased", exclude_models=["perceptron", "boosted_trees", "random_forest", "factorization", "linear_svc", "ridge_logistic"])
    assert out.target.ml_type == "binary_01" and out.roles["gender"] == "categorical-nominal"
    assert out.gate.first()["can_proceed"]
    best = out.leaderboard.orderBy("rank").first()
    assert best["model"] == out.winner and best["accuracy"] > 0.8
    assert out.importance.orderBy(F.desc("score")).first()["feature"] == "income"
    path = flow.save_outcome(out, spark, str(tmp_path / "run"))
    again = PipelineModel.load(f"{path}/model")
    clean = df.fillna({"income": 1250.0})
    a, b = (m.transform(clean).select("row_no", "prediction") for m in (out.model, again))
    assert a.exceptAll(b).count() == 0 and a.count() == 150


def test_gate_stops_the_flow(spark):
    df = spark.createDataFrame([(i, None, None, None, "x") for i in range(40)], "id int, a double, b double, c double, label string")
    with pytest.raises(flow.GateFailed):
        flow.run_table(df, ["id"], "label")
