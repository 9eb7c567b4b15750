"""Expectations, the gate, cleaning and its audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed_values as fv
from ...operators import cleaning, expectations as E, roles as R
from .base import HOLED, HOLED_SQL, ORDERS, holed, query, r, rounded, table, union

COUNT = "(SELECT count(*) FROM orders)"


def one(spark, d, *expectations, compat=False, source="orders"):
    """Evaluate a few expectations over a whole table."""
    out = E.run_suite(table(spark, d, source), expectations, compat)
    return rounded(out.drop("position"))


def row(kind, column, success, observed="CAST(NULL AS DOUBLE)", count=COUNT):
    return (
        f"SELECT '{kind}' AS expectation, '{column}' AS column_name, {success} AS success, "
        f"{observed if 'NULL' in observed else r(observed)} AS observed, {count} AS element_count"
    )


@query("exp_columns_ordered", union([row(fv.EXP_COLUMNS_ORDERED, "", "true", "6"), row(fv.EXP_COLUMNS_ORDERED, "", "false", "6")]))
def exp_columns_ordered(spark, d):
    return one(spark, d, E.Expectation(fv.EXP_COLUMNS_ORDERED, None, {"columns": list(ORDERS)}),
               E.Expectation(fv.EXP_COLUMNS_ORDERED, None, {"columns": list(reversed(ORDERS))}))


@query("exp_row_count_between", union([row(fv.EXP_ROW_COUNT, "", f"{COUNT} >= 1", COUNT), row(fv.EXP_ROW_COUNT, "", f"{COUNT} BETWEEN 1 AND 10", COUNT)]))
def exp_row_count_between(spark, d):
    return one(spark, d, E.Expectation(fv.EXP_ROW_COUNT, None, {"min": 1, "max": None}), E.Expectation(fv.EXP_ROW_COUNT, None, {"min": 1, "max": 10}))


@query("exp_column_exists", union([row(fv.EXP_COLUMN_EXISTS, "o_custkey", "true"), row(fv.EXP_COLUMN_EXISTS, "o_absent", "false")]))
def exp_column_exists(spark, d):
    return one(spark, d, E.Expectation(fv.EXP_COLUMN_EXISTS, "o_custkey"), E.Expectation(fv.EXP_COLUMN_EXISTS, "o_absent"))


TYPE_CASES = [("o_custkey", "int", True), ("o_totalprice", "int", False), ("o_custkey", "float", True), ("o_orderstatus", "str", True),
              ("o_totalprice", "str", False), ("o_orderdate", "datetime", True), ("o_absent", "int", False)]


@query("exp_type", union([row(fv.EXP_TYPE, c, str(ok).lower()) for c, _, ok in TYPE_CASES]))
def exp_type(spark, d):
    return one(spark, d, *[E.Expectation(fv.EXP_TYPE, c, {"type": t}) for c, t, _ in TYPE_CASES])


@query("exp_not_null_mostly", f"WITH {HOLED_SQL} " + union([
    row(fv.EXP_NOT_NULL, c, f"count({c}) / count(*) >= 0.85", f"count({c}) / count(*)", "count(*)") + " FROM h" for c in HOLED]))
def exp_not_null_mostly(spark, d):
    suite = [E.Expectation(fv.EXP_NOT_NULL, c, {"mostly": 0.85}) for c in HOLED]
    return rounded(E.run_suite(holed(spark, d), suite).drop("position"))


@query("exp_in_set", union([
    row(fv.EXP_IN_SET, "quality", "count(*) FILTER (quality NOT IN (0, 1)) = 0", "count(*) FILTER (quality NOT IN (0, 1))", "count(*)") + " FROM labels",
    row(fv.EXP_IN_SET, "toxic", "count(*) FILTER (toxic NOT IN (0)) = 0", "count(*) FILTER (toxic NOT IN (0))", "count(*)") + " FROM labels"]))
def exp_in_set(spark, d):
    return one(spark, d, E.Expectation(fv.EXP_IN_SET, "quality", {"values": [0, 1]}), E.Expectation(fv.EXP_IN_SET, "toxic", {"values": [0]}), source="labels")


@query("exp_in_type_list", union([row(fv.EXP_IN_TYPE_LIST, "o_custkey", "false"), row(fv.EXP_IN_TYPE_LIST, "o_orderstatus", "true")]))
def exp_in_type_list(spark, d):
    return one(spark, d, E.Expectation(fv.EXP_IN_TYPE_LIST, "o_custkey", {"types": ["bool"]}), E.Expectation(fv.EXP_IN_TYPE_LIST, "o_orderstatus", {"types": ["str"]}))


def same_set(c, values, source):
    wanted = ", ".join(f"'{v}'" for v in values)
    return f"count(DISTINCT {c}) = {len(values)} AND count(*) FILTER ({c} NOT IN ({wanted})) = 0", f"count(DISTINCT {c})"


SET_CASES = [("o_orderstatus", ["F", "O", "P"]), ("o_orderpriority", ["1-URGENT", "5-LOW"])]


@query("exp_distinct_equal_set", union([row(fv.EXP_DISTINCT_SET, c, *same_set(c, v, "orders"), "count(*)") + " FROM orders" for c, v in SET_CASES]))
def exp_distinct_equal_set(spark, d):
    return one(spark, d, *[E.Expectation(fv.EXP_DISTINCT_SET, c, {"values": v}) for c, v in SET_CASES])


UNIQUE_CASES = [("o_orderstatus", 1, 50), ("o_custkey", 1, 50), ("o_orderpriority", 3, None), ("o_orderstatus", 2, 2)]


@query("exp_unique_count_between", union([
    row(fv.EXP_UNIQUE_COUNT, c, f"count(DISTINCT {c}) BETWEEN {a} AND {b or 10 ** 9}", f"count(DISTINCT {c})", "count(*)") + " FROM orders" for c, a, b in UNIQUE_CASES]))
def exp_unique_count_between(spark, d):
    return one(spark, d, *[E.Expectation(fv.EXP_UNIQUE_COUNT, c, {"min": a, "max": b}) for c, a, b in UNIQUE_CASES])


BETWEEN_CASES = [("o_totalprice", 10000, 490000, 0.95), ("o_totalprice", 10000, None, 0.99), ("o_custkey", None, 5, 0.95)]


@query("exp_between_mostly", union([
    row(fv.EXP_BETWEEN, c, f"count(*) FILTER ({c} BETWEEN {a or 0} AND {b or 10 ** 9}) / count({c}) >= {m}",
        f"count(*) FILTER ({c} BETWEEN {a or 0} AND {b or 10 ** 9}) / count({c})", "count(*)") + " FROM orders" for c, a, b, m in BETWEEN_CASES]))
def exp_between_mostly(spark, d):
    return one(spark, d, *[E.Expectation(fv.EXP_BETWEEN, c, {"min": a, "max": b, "mostly": m}) for c, a, b, m in BETWEEN_CASES])


# -- whole suites: lineitem with one column that breaks the suite ------------

SUITE_ROLES = {
    "l_orderkey": "numeric-discrete", "l_linenumber": "numeric-discrete", "l_extendedprice": "numeric-continuous",
    "l_quantity": "numeric-discrete", "l_discount": "numeric-continuous", "l_returnflag": "categorical-nominal",
    "l_linestatus": "categorical-nominal", "l_taxed": "boolean",
}
WRONG_TYPE = {"l_quantity": "str"}  # a type the data does not have


def suite_specs():
    kinds = {c: (WRONG_TYPE.get(c, HOLED[c]), role) for c, role in SUITE_ROLES.items()}
    suite = E.build_suite([*HOLED, "l_absent"], kinds, R.Target("l_returnflag", "classification", "multiclass_text_labels"))
    return suite


def suite_rows() -> list[str]:
    """The same suite written as SQL rows."""
    n = "(SELECT count(*) FROM h)"
    rows = [row(fv.EXP_COLUMNS_ORDERED, "", "false", str(len(HOLED)), n), row(fv.EXP_ROW_COUNT, "", f"{n} >= 1", n, n)]
    for c, k in HOLED.items():
        dtype, role = WRONG_TYPE.get(c, k), SUITE_ROLES[c]
        rows.append(row(fv.EXP_COLUMN_EXISTS, c, "true", count=n))
        rows.append(row(fv.EXP_TYPE, c, str(dtype == k).lower(), count=n))
        rows.append(row(fv.EXP_NOT_NULL, c, f"count({c}) / count(*) >= 0.7", f"count({c}) / count(*)", "count(*)") + " FROM h")
        if role == "categorical-nominal":
            rows.append(row(fv.EXP_UNIQUE_COUNT, c, f"count(DISTINCT {c}) BETWEEN 1 AND 50", f"count(DISTINCT {c})", "count(*)") + " FROM h")
        elif role == "boolean":
            rows.append(row(fv.EXP_UNIQUE_COUNT, c, f"count(DISTINCT {c}) BETWEEN 2 AND 3", f"count(DISTINCT {c})", "count(*)") + " FROM h")
        elif dtype in ("int", "float"):
            rows.append(row(fv.EXP_BETWEEN, c, "true", "1", n))
    rows.append(row(fv.EXP_COLUMN_EXISTS, "l_absent", "false", count=n))
    rows.append(row(fv.EXP_UNIQUE_COUNT, "l_returnflag", "count(DISTINCT l_returnflag) >= 3", "count(DISTINCT l_returnflag)", "count(*)") + " FROM h")
    return rows


SUITE_SQL = f"{HOLED_SQL}, e AS ({union(suite_rows())})"


def suite_results(spark, d):
    return E.run_suite(holed(spark, d), suite_specs())


def generated_suite_sql():
    """Roles inferred from orders decide the specs."""
    from .roles import role_sql

    roles = union([role_sql("orders", c, k) for c, k in ORDERS.items()])
    per_role = f"""SELECT '{fv.EXP_COLUMN_EXISTS}' AS expectation, column_name FROM q UNION ALL
        SELECT '{fv.EXP_TYPE}', column_name FROM q UNION ALL SELECT '{fv.EXP_NOT_NULL}', column_name FROM q UNION ALL
        SELECT '{fv.EXP_UNIQUE_COUNT}', column_name FROM q WHERE role IN ('categorical-nominal', 'categorical-ordinal', 'boolean') UNION ALL
        SELECT '{fv.EXP_BETWEEN}', column_name FROM q WHERE role LIKE 'numeric-%' AND dtype IN ('int', 'float') UNION ALL
        SELECT '{fv.EXP_COLUMNS_ORDERED}', '' UNION ALL SELECT '{fv.EXP_ROW_COUNT}', '' UNION ALL
        SELECT '{fv.EXP_UNIQUE_COUNT}', 'o_orderstatus' FROM (SELECT count(DISTINCT o_orderstatus) AS u FROM orders) WHERE u > 2"""
    return f"WITH q AS ({roles}) SELECT expectation, column_name, count(*) AS n FROM ({per_role}) GROUP BY ALL"


@query("build_suite", generated_suite_sql())
def build_suite(spark, d):
    orders = table(spark, d, "orders")
    facts = R.column_facts(orders)
    kinds = {c: (f.kind, R.role_of(f)) for c, f in facts.items()}
    suite = E.build_suite(orders.columns, kinds, R.target_of(facts["o_orderstatus"]))
    return E.suite_table(spark, suite).groupBy("expectation", "column_name").agg(F.count("*").alias("n"))


@query("run_suite", f"WITH {SUITE_SQL} SELECT * FROM e")
def run_suite(spark, d):
    return rounded(suite_results(spark, d).drop("position"))


GATE_SQL = "g AS (SELECT count(*) AS evaluated, count(*) FILTER (NOT success) AS unsuccessful, count(*) FILTER (success) / count(*) AS success_rate FROM e)"


def gate_sql(threshold):
    return f"""WITH {SUITE_SQL}, {GATE_SQL} SELECT evaluated, unsuccessful, {r('success_rate')} AS success_rate,
    CASE WHEN unsuccessful > 0 AND success_rate < {threshold} THEN 'failed' WHEN unsuccessful = 0 THEN 'completed' ELSE 'completed_with_warnings' END AS status,
    unsuccessful = 0 OR success_rate >= {threshold} AS can_proceed FROM g"""


@query("validation_gate", gate_sql(0.90))
def validation_gate(spark, d):
    return rounded(E.gate(suite_results(spark, d)))


@query("validation_proceed_95", gate_sql(0.95))
def validation_proceed_95(spark, d):
    return rounded(E.gate(suite_results(spark, d), fv.GATE_STRICT_RATE))


@query("critical_failures", f"WITH {SUITE_SQL} SELECT expectation, column_name FROM e WHERE NOT success AND expectation IN ({', '.join(repr(x) for x in fv.CRITICAL_EXPECTATIONS)})")
def critical_failures(spark, d):
    return E.critical_failures(suite_results(spark, d))


@query("failure_rollup", f"""WITH {SUITE_SQL} SELECT 'column' AS grouping, CASE WHEN column_name = '' THEN 'table_level' ELSE column_name END AS key, count(*) AS n_failed FROM e WHERE NOT success GROUP BY 2
    UNION ALL SELECT 'expectation', expectation, count(*) FROM e WHERE NOT success GROUP BY 2""")
def failure_rollup(spark, d):
    return E.failure_rollup(suite_results(spark, d))


# -- cleaning ----------------------------------------------------------------

def mode_sql(c, source="h"):
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("impute_numeric_median", f"""WITH {HOLED_SQL} SELECT l_orderkey, l_linenumber, {r('coalesce(l_quantity, (SELECT median(l_quantity) FROM h))')} AS l_quantity,
    {r('coalesce(l_discount, (SELECT median(l_discount) FROM h))')} AS l_discount FROM h""")
def impute_numeric_median(spark, d):
    h = holed(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    roles = {"l_quantity": "numeric-discrete", "l_discount": "numeric-continuous"}
    return rounded(cleaning.apply_fills(h, cleaning.fit_fills(h, roles)))


@query("impute_categorical_mode", f"""WITH {HOLED_SQL} SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, {mode_sql('l_returnflag')}) AS l_returnflag,
    coalesce(l_linestatus, {mode_sql('l_linestatus')}) AS l_linestatus, '_UNKNOWN_' AS l_void FROM h""")
def impute_categorical_mode(spark, d):
    h = holed(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.lit(None).cast("string").alias("l_void"))
    roles = {"l_returnflag": "categorical-nominal", "l_linestatus": "categorical-ordinal", "l_void": "text"}
    return cleaning.apply_fills(h, cleaning.fit_fills(h, roles))


@query("impute_boolean_mode", f"WITH {HOLED_SQL} SELECT l_orderkey, l_linenumber, coalesce(l_taxed, {mode_sql('l_taxed')}) AS l_taxed, false AS l_void FROM h")
def impute_boolean_mode(spark, d):
    h = holed(spark, d).select("l_orderkey", "l_linenumber", "l_taxed", F.lit(None).cast("boolean").alias("l_void"))
    return cleaning.apply_fills(h, cleaning.fit_fills(h, {"l_taxed": "boolean", "l_void": "boolean"}))


@query("impute_unknown_role", f"""WITH {HOLED_SQL} SELECT l_orderkey, l_linenumber, {r('coalesce(l_quantity, (SELECT median(l_quantity) FROM h))')} AS l_quantity,
    coalesce(l_returnflag, '_UNKNOWN_') AS l_returnflag FROM h""")
def impute_unknown_role(spark, d):
    h = holed(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rounded(cleaning.apply_fills(h, cleaning.fit_fills(h, {"l_quantity": "other", "l_returnflag": "other"})))


CLEAN_COLUMNS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_taxed"]
CLEAN_ROLES = {c: SUITE_ROLES[c] for c in CLEAN_COLUMNS}
FILLED_SQL = f"""{HOLED_SQL}, f AS (SELECT {r('coalesce(l_quantity, (SELECT median(l_quantity) FROM h))')} AS l_quantity,
    {r('coalesce(l_discount, (SELECT median(l_discount) FROM h))')} AS l_discount, coalesce(l_returnflag, {mode_sql('l_returnflag')}) AS l_returnflag,
    coalesce(l_linestatus, {mode_sql('l_linestatus')}) AS l_linestatus, coalesce(l_taxed, {mode_sql('l_taxed')}) AS l_taxed FROM h)"""


@query("clean_pipeline", f"WITH {FILLED_SQL} SELECT DISTINCT * FROM f")
def clean_pipeline(spark, d):
    return rounded(cleaning.clean(holed(spark, d).select(*CLEAN_COLUMNS), CLEAN_ROLES))


@query("cleaning_audit", f"WITH {FILLED_SQL} " + union([
    f"SELECT 'impute' AS step, '{c}' AS column_name, '{'median' if c in ('l_quantity', 'l_discount') else 'mode'}' AS method, "
    f"count(*) FILTER ({c} IS NULL) AS n_affected FROM h" for c in CLEAN_COLUMNS]) +
    " UNION ALL SELECT 'deduplicate', '', 'distinct', (SELECT count(*) FROM f) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f))")
def cleaning_audit(spark, d):
    return cleaning.cleaning_audit(holed(spark, d).select(*CLEAN_COLUMNS), CLEAN_ROLES).drop("fill_value")


