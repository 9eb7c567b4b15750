import pytest

from tabwright.functions import fixed_values as fv
from tabwright.operators import expectations as E
from tabwright.operators.roles import Target


def results(df, *suite, compat=False):
    return [r["success"] for r in E.run_suite(df, suite, compat).orderBy("position").collect()]


def test_compat_passes_what_is_not_judged(small):
    bad = E.Expectation(fv.EXP_IN_SET, "purchased", {"values": [7]})
    assert results(small, bad) == [False]
    assert results(small, bad, compat=True) == [True]


def test_missing_column_fails_and_is_critical(small):
    suite = E.build_suite(["row_no", "absent"], {"absent": ("int", "numeric-discrete")})
    out = E.run_suite(small, suite)
    failed = {(r["expectation"], r["column_name"]) for r in out.where("not success").collect()}
    assert (fv.EXP_COLUMN_EXISTS, "absent") in failed and (fv.EXP_COLUMNS_ORDERED, "") in failed
    assert E.critical_failures(out).count() == 3
    assert E.gate(out).first()["status"] == "failed"


def test_empty_table_fails(spark, small):
    suite = E.build_suite(small.columns, {c: ("float", "text") for c in ("income",)})
    got = {(r["expectation"], r["column_name"]): r["success"] for r in E.run_suite(small.limit(0), suite).collect()}
    assert not got[(fv.EXP_ROW_COUNT, "")] and not got[(fv.EXP_NOT_NULL, "income")]


@pytest.mark.parametrize("ml_type,kinds", [
    ("binary_01", [fv.EXP_IN_SET]), ("binary_boolean", [fv.EXP_IN_TYPE_LIST]),
    ("binary_numeric", [fv.EXP_DISTINCT_SET, fv.EXP_UNIQUE_COUNT]), ("multiclass_text_labels", [fv.EXP_UNIQUE_COUNT]),
    ("numeric_continuous", [fv.EXP_TYPE]), ("binary_text_labels", []),
])
def test_target_expectations(ml_type, kinds):
    task = "regression" if ml_type == "numeric_continuous" else "classification"
    assert [e.kind for e in E.target_expectations(Target("t", task, ml_type))] == kinds


def test_clean_suite_completes(small):
    roles = {"customer_age": ("int", "numeric-discrete"), "gender": ("str", "categorical-nominal"), "purchased": ("int", "boolean")}
    out = E.run_suite(small, E.build_suite(small.columns, roles, Target("purchased", "classification", "binary_01")))
    verdict = E.gate(out).first()
    assert verdict["status"] == "completed" and verdict["can_proceed"] and E.suite_statistics(out).first()["success_pct"] == 100.0
