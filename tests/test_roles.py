import pytest
from pyspark.sql import functions as F

from tabwright.functions.columns import feature_category
from tabwright.operators import roles as R


def role(spark, name, values, kind):
    return R.suggest_roles(spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}"))[name]


@pytest.mark.parametrize("name,values,kind,want", [
    ("bedroom_count", [1, 2, 3, 4, 5], "int", "numeric-discrete"),
    ("consecutive_2_6", [2, 3, 4, 5, 6], "int", "numeric-discrete"),
    ("weird_ids", [1, 3, 7, 15, 31], "int", "categorical-nominal"),
    ("status_codes", [100, 200, 404, 500, 503], "int", "categorical-nominal"),
    ("many_floats", [1.1, 2.2, 3.3], "double", "numeric-continuous"),
    ("whole", [1.0, 3.0, 7.0, None], "double", "categorical-nominal"),
    ("flag", [0, 1, 1, None], "int", "boolean"),
    ("flag", [0.0, 1.0], "double", "boolean"),
    ("single", [4, 4], "int", "numeric-discrete"),
    ("void", [None, None], "double", "numeric-continuous"),
    ("really", [True, False], "boolean", "boolean"),
    ("property_type", ["Condo", "Ranch", "Condo"], "string", "categorical-nominal"),
    ("customer_id", ["a", "b"], "string", "text"),
    ("note", [f"note {i}" for i in range(50)], "string", "text"),
    ("town", [f"town {i % 30}" for i in range(60)], "string", "categorical-nominal"),
])
def test_role_rules(spark, name, values, kind, want):
    assert role(spark, name, values, kind) == want


def test_role_by_exact_count_near_the_ratio(spark):
    at = [f"v{i % 80}" for i in range(100)]       # exactly 0.8: not above it
    above = [f"v{i % 81}" for i in range(100)]
    assert role(spark, "t", at, "string") == "categorical-nominal"
    assert role(spark, "t", above, "string") == "text"


def test_targets(spark, small):
    assert R.suggest_target_name(["a", "My_Label", "b"]) == "My_Label"
    assert R.suggest_target_name(["a", "b"]) == "b"
    kinds = {c: R.suggest_target(small, c).ml_type for c in ("purchased", "customer_age", "income", "gender", "seen")}
    assert kinds == {
        "purchased": "binary_01", "customer_age": "numeric_continuous", "income": "numeric_continuous",
        "gender": "multiclass_text_labels", "seen": "high_cardinality_text",
    }
    with pytest.raises(ValueError):
        R.Target("t", "ranking", "binary_01")


def test_merge_and_metadata(small):
    merged = R.merge_roles({"a": "text", "b": "boolean"}, {"a": "identifier_ignore"})
    assert merged == [("a", "identifier_ignore", "user_confirmed"), ("b", "boolean", "system_defaulted")]
    with pytest.raises(ValueError):
        R.merge_roles({"a": "text"}, {"c": "text"})
    tagged = R.with_roles(small, {"income": "numeric-continuous"}).where(F.col("income") > 0)
    assert R.roles_of(tagged) == {"income": "numeric-continuous"}


def test_categories():
    assert feature_category("customer_age") == "demographic"
    assert feature_category("unit_price") == "financial"
    assert feature_category("x1") == "general"


def test_key_features_when_scorers_fail(small, monkeypatch):
    """|r| when the scorer of the task fails, the first columns when that fails too."""
    from tabwright.operators import importance as I

    def fail(*_):
        raise ValueError("no scores")

    goal = R.Target("purchased", "classification", "binary_01")
    rows = small.select("row_no", "customer_age", "income", "gender", "purchased")
    monkeypatch.setattr(I, "feature_scores", fail)
    with pytest.warns(UserWarning):
        got = I.key_features(rows, goal, 3)
    assert got == [r["column_name"] for r in I.top_features(I.correlation_fallback(rows, "purchased"), 3).collect()]
    monkeypatch.setattr(I, "correlation_fallback", fail)
    with pytest.warns(UserWarning):
        assert I.key_features(rows, goal, 3) == ["row_no", "customer_age", "income"]
