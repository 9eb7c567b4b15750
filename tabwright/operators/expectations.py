"""Data-quality expectations: a list of specs compiled into one aggregate.

Schema-only checks are decided from `df.schema`; every data check adds a few
aggregate expressions.  Distinct-value checks read one frequency table over the
columns that need it, never an array of values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, count_where, kinds, numeric_columns
from .frequencies import is_value, value_frequencies
from .roles import Target

TYPE_LISTS = {"int": ("int",), "float": ("float", "int"), "str": ("str",)}
RESULT_SCHEMA = (
    "position int, expectation string, column_name string, success boolean, observed double, element_count bigint"
)


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None = None
    args: Mapping[str, object] = field(default_factory=dict)


def target_expectations(target: Target) -> list[Expectation]:
    t, c = target.ml_type, target.name
    if t == "binary_01":
        return [Expectation(fv.EXP_IN_SET, c, {"values": [0, 1]})]
    if t == "binary_boolean":
        return [Expectation(fv.EXP_IN_TYPE_LIST, c, {"types": ["bool"]})]
    if t == "binary_numeric":
        return [
            Expectation(fv.EXP_DISTINCT_SET, c, {"values": None}),
            Expectation(fv.EXP_UNIQUE_COUNT, c, {"min": 2, "max": 2}),
        ]
    if t in ("multiclass_int_labels", "multiclass_text_labels", "high_cardinality_text"):
        return [Expectation(fv.EXP_UNIQUE_COUNT, c, {"min": 3, "max": None})]
    if t == "numeric_continuous":
        return [Expectation(fv.EXP_TYPE, c, {"type": "float"})]
    return []


def build_suite(
    columns: Sequence[str],
    roles: Mapping[str, tuple[str, str]],
    target: Target | None = None,
    bounds: Mapping[str, tuple[float, float]] | None = None,
) -> list[Expectation]:
    """Specs for a table; `roles` maps a column to its (folded dtype, role).

    `bounds` are the ranges of numeric columns, as `numeric_bounds` learns them from a reference table;
    without them the range check of a column has no limits and cannot fail.
    """
    suite = [
        Expectation(fv.EXP_COLUMNS_ORDERED, None, {"columns": list(columns)}),
        Expectation(fv.EXP_ROW_COUNT, None, {"min": 1, "max": None}),
    ]
    for c in columns:
        suite.append(Expectation(fv.EXP_COLUMN_EXISTS, c))
        if c not in roles:
            continue
        dtype, role = roles[c]
        suite.append(Expectation(fv.EXP_TYPE, c, {"type": dtype}))
        suite.append(Expectation(fv.EXP_NOT_NULL, c, {"mostly": 1.0 - fv.MISSING_SHARE_ALLOWED}))
        if role in ("categorical-nominal", "categorical-ordinal"):
            suite.append(Expectation(fv.EXP_UNIQUE_COUNT, c, {"min": 1, "max": fv.CATEGORY_LEVELS_ALLOWED}))
        elif role == "boolean":
            suite.append(Expectation(fv.EXP_UNIQUE_COUNT, c, {"min": 2, "max": 3}))
        elif role in ("numeric-continuous", "numeric-discrete") and dtype in ("int", "float"):
            low, high = (bounds or {}).get(c, (None, None))
            suite.append(Expectation(fv.EXP_BETWEEN, c, {"min": low, "max": high, "mostly": fv.BETWEEN_MOSTLY}))
    if target is not None and target.name in columns:
        suite += target_expectations(target)
    return suite


def suite_table(spark, suite: Sequence[Expectation]) -> DataFrame:
    """The suite as rows (position, expectation, column_name)."""
    rows = [(i, e.kind, e.column or "") for i, e in enumerate(suite)]
    return spark.createDataFrame(rows, "position int, expectation string, column_name string")


def _needs_distinct(e: Expectation) -> bool:
    return e.kind in (fv.EXP_UNIQUE_COUNT, fv.EXP_DISTINCT_SET)


def _set_test(df: DataFrame, e: Expectation):
    """Is this frequency row a value of the expected set?"""
    values = e.args["values"]
    slot = {"int": "l", "bool": "l", "datetime": "l", "float": "d", "str": "s"}[kinds(df)[e.column]]
    return F.col(slot).isin(values)


def run_suite(df: DataFrame, suite: Sequence[Expectation], compat: bool = False) -> DataFrame:
    """(position, expectation, column_name, success, observed, element_count).

    With `compat` only the five basic types are judged and the rest pass.
    """
    folded = kinds(df)
    exprs = {"rows": F.count(F.lit(1))}
    judged = [e for e in suite if not compat or e.kind in fv.EXPECTATIONS_EVALUATED_IN_COMPAT]
    for e in judged:
        c = e.column
        if c is not None and c not in folded:
            continue
        if e.kind == fv.EXP_NOT_NULL:
            exprs[f"nn:{c}"] = F.count(col(c))
        elif e.kind == fv.EXP_IN_SET:
            exprs[f"set:{c}"] = count_where(~col(c).isin(list(e.args["values"])))
            exprs[f"nn:{c}"] = F.count(col(c))
        elif e.kind == fv.EXP_BETWEEN:
            low, high = e.args.get("min"), e.args.get("max")
            if low is not None or high is not None:
                ok = F.lit(True)
                ok = ok & (col(c) >= F.lit(low)) if low is not None else ok
                ok = ok & (col(c) <= F.lit(high)) if high is not None else ok
                exprs[f"bt:{c}:{low}:{high}"] = count_where(ok)
            exprs[f"nn:{c}"] = F.count(col(c))
    seen = df.agg(*[v.alias(k) for k, v in exprs.items()]).first().asDict()

    wanted = sorted({e.column for e in judged if _needs_distinct(e) and e.column in folded})
    distinct, members = {}, {}
    if wanted:
        freq = value_frequencies(df, wanted)
        sets = [e for e in judged if e.kind == fv.EXP_DISTINCT_SET and e.column in folded and e.args["values"] is not None]
        extra = [
            count_where(is_value() & (F.col("column_name") == e.column) & _set_test(df, e)).alias(f"m{i}")
            for i, e in enumerate(sets)
        ]
        for r in freq.groupBy("column_name").agg(count_where(is_value()).alias("n_unique"), *extra).collect():
            distinct[r["column_name"]] = r["n_unique"]
            for i, e in enumerate(sets):
                if e.column == r["column_name"]:
                    members[id(e)] = r[f"m{i}"]
    rows = []
    for i, e in enumerate(suite):
        auto = compat and e.kind not in fv.EXPECTATIONS_EVALUATED_IN_COMPAT
        ok, observed = (True, None) if auto else _judge(e, df, folded, seen, distinct, members)
        rows.append((i, e.kind, e.column or "", bool(ok), None if observed is None else float(observed), seen["rows"]))
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def _within(x, low, high) -> bool:
    return (low is None or x >= low) and (high is None or x <= high)


def _judge(e: Expectation, df, folded, seen, distinct, members):
    n = seen["rows"]
    if e.kind == fv.EXP_COLUMNS_ORDERED:
        return df.columns == list(e.args["columns"]), len(df.columns)
    if e.kind == fv.EXP_ROW_COUNT:
        return _within(n, e.args.get("min"), e.args.get("max")), n
    if e.kind == fv.EXP_COLUMN_EXISTS:
        return e.column in folded, None
    if e.column not in folded:
        return False, None
    if e.kind == fv.EXP_TYPE:
        allowed = TYPE_LISTS.get(e.args["type"])  # other types are not checked
        return allowed is None or folded[e.column] in allowed, None
    if e.kind == fv.EXP_IN_TYPE_LIST:
        return folded[e.column] in e.args["types"], None
    if e.kind == fv.EXP_NOT_NULL:
        share = seen[f"nn:{e.column}"] / n if n else 0.0
        return share >= e.args["mostly"], share
    if e.kind == fv.EXP_IN_SET:
        return seen[f"set:{e.column}"] == 0, seen[f"set:{e.column}"]
    if e.kind == fv.EXP_UNIQUE_COUNT:
        u = distinct.get(e.column, 0)
        return _within(u, e.args.get("min"), e.args.get("max")), u
    if e.kind == fv.EXP_DISTINCT_SET:
        u = distinct.get(e.column, 0)
        if e.args["values"] is None:  # the set is whatever the data holds
            return True, u
        return u == len(set(e.args["values"])) == members[id(e)], u
    if e.kind == fv.EXP_BETWEEN:
        low, high, present = e.args.get("min"), e.args.get("max"), seen[f"nn:{e.column}"]
        inside = present if low is None and high is None else seen[f"bt:{e.column}:{low}:{high}"]
        share = inside / present if present else 1.0
        return share >= e.args["mostly"], share
    raise ValueError(f"unknown expectation {e.kind}")


def suite_statistics(results: DataFrame) -> DataFrame:
    """(evaluated, successful, unsuccessful, success_pct)."""
    n, ok = F.count("*"), count_where(F.col("success"))
    return results.agg(
        n.alias("evaluated"), ok.alias("successful"), (n - ok).alias("unsuccessful"),
        F.coalesce(ok * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("success_pct"),
    )


def gate(results: DataFrame, threshold: float = fv.GATE_SUCCESS_RATE) -> DataFrame:
    """(evaluated, unsuccessful, success_rate, status, can_proceed)."""
    n, ok = F.count("*"), count_where(F.col("success"))
    rate = F.coalesce(ok / F.nullif(n, F.lit(0)), F.lit(0.0))
    table = results.agg(n.alias("evaluated"), (n - ok).alias("unsuccessful"), rate.alias("success_rate"))
    clean = (F.col("unsuccessful") == 0) & (F.col("evaluated") > 0)
    proceed = clean | (F.col("success_rate") >= threshold)
    status = F.when(~proceed, "failed").when(clean, "completed").otherwise("completed_with_warnings")
    return table.withColumn("status", status).withColumn("can_proceed", proceed)


def critical_failures(results: DataFrame) -> DataFrame:
    failed = results.where(~F.col("success") & F.col("expectation").isin(*fv.CRITICAL_EXPECTATIONS))
    return failed.select("expectation", "column_name")


def failure_rollup(results: DataFrame) -> DataFrame:
    """(grouping, key, n_failed) by column and by expectation, in one pass."""
    failed = results.where(~F.col("success"))
    key = F.when(F.col("column_name") == "", "table_level").otherwise(F.col("column_name"))
    return (
        failed.select(F.stack(F.lit(2), F.lit("column"), key, F.lit("expectation"), F.col("expectation")).alias("grouping", "key"))
        .groupBy("grouping", "key")
        .agg(F.count("*").alias("n_failed"))
    )


def numeric_bounds(df: DataFrame) -> Mapping[str, tuple[float, float]]:
    """Bounds learned from a reference table, for `expect_column_values_to_be_between`."""
    names = numeric_columns(df)
    row = df.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(names)}


