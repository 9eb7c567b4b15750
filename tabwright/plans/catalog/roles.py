"""Role and target inference, and feature scores before training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed_values as fv
from ...operators import importance as I, neighbours as N, roles as R
from .base import CUSTOMER, HOLED_SQL, LINEITEM, ORDERS, holed, query, r, rounded, table, union
from .profiles import statistics_sql

ORDERS_TARGET = R.Target("o_orderstatus", "classification", "multiclass_text_labels")


def one_row(source: str, expr: str) -> str:
    """Source of an aggregate; a constant needs a one-row source instead."""
    return source if "(" in expr else f"(SELECT count(*) FROM {source})"


def task_sql(source: str, name: str, kind: str) -> str:
    """The target rules as SQL over one aggregate row."""
    u = f"count(DISTINCT {name})"
    if kind == "int":
        ml = (
            f"CASE WHEN {u} > 10 THEN 'numeric_continuous' WHEN {u} <> 2 THEN 'multiclass_int_labels' "
            f"WHEN min({name}) = 0 AND max({name}) = 1 THEN 'binary_01' ELSE 'binary_numeric' END"
        )
        task = f"CASE WHEN {u} > 10 THEN 'regression' ELSE 'classification' END"
    elif kind == "float":
        ml, task = "'numeric_continuous'", "'regression'"
    elif kind == "bool":
        ml, task = "'binary_boolean'", "'classification'"
    elif kind == "str":
        ml = f"CASE WHEN {u} = 2 THEN 'binary_text_labels' WHEN {u} BETWEEN 3 AND 20 THEN 'multiclass_text_labels' ELSE 'high_cardinality_text' END"
        task = "'classification'"
    else:
        ml, task = "'unknown_type'", "'classification'"
    return f"SELECT '{name}' AS target, {task} AS task, {ml} AS ml_type FROM {one_row(source, ml)}"


TARGET_CASES = [("lineitem", c, k) for c, k in LINEITEM.items()] + [("labels", "quality", "int"), ("orders", "o_orderstatus", "str"), ("customer", "c_name", "str")]


def target_table(spark, rows):
    return spark.createDataFrame(rows, "target string, task string, ml_type string")


@query("suggest_task_type", union([task_sql(s, c, k) for s, c, k in TARGET_CASES]))
def suggest_task_type(spark, d):
    rows = []
    for source in ("lineitem", "labels", "orders", "customer"):
        names = [c for s, c, _ in TARGET_CASES if s == source]
        for f in R.column_facts(table(spark, d, source), names).values():
            t = R.target_of(f)
            rows.append((t.name, t.task, t.ml_type))
    return target_table(spark, rows)


def options_sql(source, c, kind):
    u = f"count(DISTINCT {c})"
    if kind in ("int", "float"):
        legal = f"CASE WHEN {u} <> 2 THEN 'multiclass_int_labels' WHEN min({c}) = 0 AND max({c}) = 1 THEN 'binary_01' ELSE 'binary_numeric' END"
    else:
        legal = f"CASE WHEN {u} = 2 THEN 'binary_text_labels' WHEN {u} > 20 THEN 'multiclass_text_labels,high_cardinality_text' ELSE 'multiclass_text_labels' END"
    return [f"SELECT '{c}' AS column_name, 'classification' AS task, {legal} AS options FROM {source}",
            f"SELECT '{c}', 'regression', 'numeric_continuous' FROM (SELECT count(*) FROM {source})"]


OPTION_CASES = [("orders", c, k) for c, k in ORDERS.items() if k != "datetime"] + [("labels", "quality", "int"), ("customer", "c_name", "str")]


@query("target_ml_type_options", union([q for case in OPTION_CASES for q in options_sql(*case)]))
def target_ml_type_options(spark, d):
    rows = []
    for source in ("orders", "labels", "customer"):
        facts = R.column_facts(table(spark, d, source), [c for s, c, _ in OPTION_CASES if s == source])
        rows += [(c, task, ",".join(R.target_type_options(f, task))) for c, f in facts.items() for task in fv.TASKS]
    return spark.createDataFrame(rows, "column_name string, task string, options string")


def role_sql(source: str, c: str, kind: str) -> str:
    """The role decision tree as SQL over one aggregate row."""
    u, n = f"count(DISTINCT {c})", f"count({c})"
    has = lambda words: any(w in c.lower() for w in words)
    if kind == "bool":
        role = "'boolean'"
    elif kind in ("int", "float"):
        few = "'numeric-discrete'" if has(fv.NUMERIC_NAME_WORDS) else (
            f"CASE WHEN {u} > 10 OR {u} = 1 OR max({c}) - min({c}) + 1 = {u} THEN 'numeric-discrete' ELSE 'categorical-nominal' END")
        role = (
            f"CASE WHEN {n} = 0 OR NOT bool_and({c} = floor({c})) THEN 'numeric-continuous' "
            f"WHEN {u} = 2 AND min({c}) = 0 AND max({c}) = 1 THEN 'boolean' ELSE {few} END")
    elif kind == "datetime":
        role = "'datetime'"
    elif has(fv.IDENTIFIER_NAME_WORDS):
        role = "'text'"
    else:
        role = f"CASE WHEN {u} <= 20 THEN 'categorical-nominal' WHEN {u} / {n} > 0.8 THEN 'text' ELSE 'categorical-nominal' END"
    return f"SELECT '{c}' AS column_name, '{kind}' AS dtype, {role} AS role FROM {one_row(source, role)}"


# Columns that reach every branch of the decision tree.
ROLE_EXPRS = {
    "o_orderkey": ("o_orderkey", "int"), "o_totalprice": ("o_totalprice", "float"), "o_orderdate": ("o_orderdate", "datetime"),
    "o_orderstatus": ("o_orderstatus", "str"), "o_orderpriority": ("o_orderpriority", "str"),
    "o_flag": ("CAST(o_orderkey % 2 AS INT)", "int"), "o_gaps": ("CAST(o_orderkey % 3 * 5 AS INT)", "int"),
    "o_steps": ("CAST(o_orderkey % 4 AS INT)", "int"), "o_rank": ("CAST(o_orderkey % 3 * 5 AS INT)", "int"),
    "o_one": ("CAST(o_orderkey * 0 AS INT)", "int"), "o_whole": ("CAST(o_orderkey % 9 * 2 AS DOUBLE)", "float"),
    "o_open": ("o_orderstatus = 'O'", "bool"), "o_note": ("concat(o_orderpriority, ' note ', {key})", "str"),
    "o_uid": ("concat('u', o_orderstatus)", "str"), "o_group": ("concat('g', {mod})", "str"),
    "o_none": ("CAST(NULL AS DOUBLE)", "float"),
}


def role_exprs(text: str) -> list[str]:
    fill = {"key": f"CAST(o_orderkey AS {text})", "mod": f"CAST(o_orderkey % 40 AS {text})"}
    return [f"{e.format(**fill)} AS {c}" for c, (e, _) in ROLE_EXPRS.items()]


ROLE_SQL = f"q AS (SELECT {', '.join(role_exprs('VARCHAR'))} FROM orders)"
ROLE_ROWS = union([role_sql("q", c, k) for c, (_, k) in ROLE_EXPRS.items()])


def role_input(spark, d):
    return table(spark, d, "orders").selectExpr(*role_exprs("string"))


@query("suggest_encoding_roles", f"WITH {ROLE_SQL} {ROLE_ROWS}")
def suggest_encoding_roles(spark, d):
    return R.role_table(role_input(spark, d))


@query("numeric_role", f"WITH {ROLE_SQL} SELECT column_name, role FROM (" + union([
    role_sql("q", c, k).replace(f"WHEN count(DISTINCT {c}) = 2 AND min({c}) = 0 AND max({c}) = 1 THEN 'boolean' ", "")
    for c, (_, k) in ROLE_EXPRS.items() if k in ("int", "float")]) + ")")
def numeric_role(spark, d):
    q = role_input(spark, d)
    names = [c for c, (_, k) in ROLE_EXPRS.items() if k in ("int", "float")]
    rows = [(c, R.numeric_role(f)) for c, f in R.column_facts(q, names).items()]
    return spark.createDataFrame(rows, "column_name string, role string")


CONFIRMED = {"o_steps": "categorical-ordinal", "o_uid": "identifier_ignore", "o_open": "boolean"}
MERGED_SQL = f"""m AS (SELECT column_name, CASE column_name {' '.join(f"WHEN '{c}' THEN '{x}'" for c, x in CONFIRMED.items())} ELSE role END AS role,
    CASE WHEN column_name IN ({', '.join(f"'{c}'" for c in CONFIRMED)}) THEN 'user_confirmed' ELSE 'system_defaulted' END AS source FROM ({ROLE_ROWS}))"""


@query("merge_confirmed_schema", f"WITH {ROLE_SQL}, {MERGED_SQL} SELECT * FROM m")
def merge_confirmed_schema(spark, d):
    return R.merged_role_table(spark, R.suggest_roles(role_input(spark, d)), CONFIRMED)


@query("target_suggestion_table", f"""WITH c AS ({union(statistics_sql('customer', CUSTOMER))}), t AS ({task_sql('customer', 'c_custkey', 'int')})
    SELECT c.*, target AS suggested_column, task AS suggested_task, ml_type AS suggested_ml_type, CAST(0.87 AS DOUBLE) AS confidence FROM c, t""")
def target_suggestion_table(spark, d):
    return rounded(R.target_suggestion_table(table(spark, d, "customer")), 2)


# -- scores ------------------------------------------------------------------

CLEAN = {
    "l_quantity": "coalesce(l_quantity, (SELECT median(l_quantity) FROM h))",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "coalesce(l_discount, (SELECT median(l_discount) FROM h))",
    "l_returnflag": "coalesce(l_returnflag, '_MISSING_')",
    "l_taxed": "coalesce(CAST(l_taxed AS INTEGER), 0)",
}
CLEAN_SQL = f"{HOLED_SQL}, c AS (SELECT {', '.join(f'{e} AS {c}' for c, e in CLEAN.items())} FROM h)"


def clean_input(spark, d):
    return holed(spark, d).select(*CLEAN)


@query("stable_clean", f"WITH {CLEAN_SQL} SELECT {r('l_quantity')} AS l_quantity, l_extendedprice, {r('l_discount')} AS l_discount, l_returnflag, l_taxed FROM c")
def stable_clean(spark, d):
    return rounded(I.stable_clean(clean_input(spark, d), "l_extendedprice"))


F_SCORE = "r * r / nullif(1 - r * r, 0) * (n - 2)"
CODED_SQL = f"""{CLEAN_SQL}, k AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code FROM c),
    rr AS ({union([f"SELECT '{c}' AS column_name, count(*) AS n, corr({'code' if c == 'l_returnflag' else c}, l_extendedprice) AS r FROM k" for c in CLEAN if c != 'l_extendedprice'])})"""


@query("f_regression_scores", f"WITH {CODED_SQL} SELECT column_name, {r(F_SCORE)} AS f_score FROM rr")
def f_regression_scores(spark, d):
    return rounded(I.f_regression_scores(clean_input(spark, d), "l_extendedprice"))


@query("correlation_fallback", f"""WITH {CLEAN_SQL} {union([
    f"SELECT '{c}' AS column_name, {r(f'coalesce(abs(corr({c}, l_extendedprice)), 0)')} AS score FROM c" if c != 'l_returnflag'
    else "SELECT 'l_returnflag', CAST(0.1 AS DOUBLE) FROM (SELECT count(*) FROM c)" for c in CLEAN if c != 'l_extendedprice'])}""")
def correlation_fallback(spark, d):
    return rounded(I.correlation_fallback(clean_input(spark, d), "l_extendedprice"))


MI_FEATURES = {"l_quantity": "float", "l_extendedprice": "float", "l_tax": "float", "l_linenumber": "int", "l_linestatus": "str", "l_name": "str"}
MI_SOURCE = "(SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS l_name FROM lineitem)"  # a unique text


def mi_input(spark, d):
    name = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("l_name")
    return table(spark, d, "lineitem").select("*", name).select(*MI_FEATURES, "l_returnflag")


def mi_sql(features, target, source):
    parts = []
    for c, k in features.items():
        if k == "str":
            x = f"CAST({c} AS VARCHAR)"
        else:
            edges = "(SELECT list_distinct([" + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {b / 8})" for b in range(1, 8)) + f"]) FROM {source})"
            x = f"CAST(len(list_filter({edges}, lambda e: {c} >= e)) AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS column_name, {x} AS x, CAST({target} AS VARCHAR) AS y FROM {source}")
    return f"""j AS (SELECT column_name, x, y, count(*) AS n FROM ({union(parts)}) GROUP BY ALL),
    p AS (SELECT *, sum(n) OVER (PARTITION BY column_name, x) AS nx, sum(n) OVER (PARTITION BY column_name, y) AS ny, sum(n) OVER (PARTITION BY column_name) AS t FROM j),
    mi AS (SELECT column_name, greatest(sum(n / t * ln(n * t / (nx * ny))) - (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) / (2 * max(t)), 0) AS mi FROM p GROUP BY 1)"""


@query("mutual_info_scores", f"WITH {mi_sql(MI_FEATURES, 'l_returnflag', MI_SOURCE)} SELECT column_name, {r('mi')} AS mi FROM mi")
def mutual_info_scores(spark, d):
    li = mi_input(spark, d)
    return rounded(I.mutual_info_scores(li, R.Target("l_returnflag", "classification", "multiclass_text_labels")))


NEAR_FEATURES = {"c_acctbal": "float", "c_nationkey": "int", "c_name": "str"}
NEAR_PARTS = union([
    f"SELECT '{c}' AS column_name, c_mktsegment AS y, CAST({c if k != 'str' else f'dense_rank() OVER (ORDER BY {c}) - 1'} AS DOUBLE) AS x FROM customer"
    for c, k in NEAR_FEATURES.items()])


@query("mutual_info_neighbours", f"""WITH pts AS (SELECT *, count(*) OVER (PARTITION BY column_name, y) AS ny FROM ({NEAR_PARTS})),
    kept AS (SELECT * FROM pts WHERE ny > 1), one AS (SELECT DISTINCT * FROM kept),
    far AS (SELECT a.column_name, a.y, a.x, a.ny, list(abs(b.x - a.x)) AS ds
        FROM one a JOIN kept b ON a.column_name = b.column_name AND a.y = b.y GROUP BY ALL),
    rad AS (SELECT column_name, y, x, ny, list_sort(ds)[least(3, ny - 1) + 1] AS r FROM far),
    lim AS (SELECT *, least(x, x - r + 1e-12::DOUBLE * (abs(x) + r)) AS low, greatest(x, x + r - 1e-12::DOUBLE * (abs(x) + r)) AS high FROM rad),
    cnt AS (SELECT l.column_name, l.y, l.x, l.ny, count(*) AS m, count(*) FILTER (k.y = l.y) AS c, count(*) FILTER (k.y = l.y AND k.x = l.x) AS n
        FROM lim l JOIN kept k ON k.column_name = l.column_name AND k.x BETWEEN l.low AND l.high GROUP BY ALL),
    psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329 AS v
        FROM range(1, (SELECT count(*) + 2 FROM customer)) t(i)),
    fin AS (SELECT column_name, sum(n) AS total, sum(n * (pc.v - py.v - pm.v)) / sum(n) AS gain
        FROM cnt JOIN psi pc ON pc.i = c JOIN psi py ON py.i = ny JOIN psi pm ON pm.i = m GROUP BY 1)
    SELECT column_name, {r('greatest(v + gain, 0)')} AS mi FROM fin JOIN psi ON i = total""")
def mutual_info_neighbours(spark, d):
    customer = table(spark, d, "customer").select(*NEAR_FEATURES, "c_mktsegment")
    return rounded(N.neighbour_mutual_info(customer, R.Target("c_mktsegment", "classification", "multiclass_text_labels")))


@query("key_features", f"""WITH {CODED_SQL}, {mi_sql(MI_FEATURES, 'l_returnflag', MI_SOURCE)}
    SELECT 'regression' AS task, column_name, {r('score')} AS score FROM (SELECT column_name, {F_SCORE} AS score FROM rr ORDER BY score DESC, column_name LIMIT 3)
    UNION ALL SELECT 'classification', column_name, {r('mi')} FROM (SELECT * FROM mi ORDER BY mi DESC, column_name LIMIT 3)""")
def key_features(spark, d):
    price = R.Target("l_extendedprice", "regression", "numeric_continuous")
    flag = R.Target("l_returnflag", "classification", "multiclass_text_labels")
    li = mi_input(spark, d)
    out = [
        I.top_features(I.feature_scores(df, t), 3).select(F.lit(t.task).alias("task"), "column_name", "score")
        for df, t in ((clean_input(spark, d), price), (li, flag))
    ]
    return rounded(out[0].unionByName(out[1]))


FEATURES = {c: k for c, k in ORDERS.items() if c not in ("o_orderstatus", "o_orderdate")}
KEY_SQL = mi_sql(FEATURES, "o_orderstatus", "orders")
FEATURE_ROLES = union([role_sql("orders", c, k) for c, k in FEATURES.items()])
TOP_KEYS = "(SELECT column_name FROM mi ORDER BY mi DESC, column_name LIMIT 2)"


@query("feature_suggestion_table", f"""WITH {KEY_SQL}, s AS ({union(statistics_sql('orders', FEATURES))}), q AS ({FEATURE_ROLES})
    SELECT s.*, q.role, s.column_name IN {TOP_KEYS} AS is_key_feature FROM s JOIN q USING (column_name)""")
def feature_suggestion_table(spark, d):
    orders = table(spark, d, "orders").drop("o_orderdate")
    out = R.feature_suggestion_table(orders, ORDERS_TARGET, 2)
    return rounded(out.where("column_name <> 'o_orderstatus'"), 1)


@query("schema_decision_summary", f"""WITH {KEY_SQL}, q AS ({FEATURE_ROLES}) SELECT count(*) AS total,
    count(*) FILTER (column_name IN ('o_custkey', 'o_orderpriority')) AS user_modified, count(*) FILTER (column_name NOT IN ('o_custkey', 'o_orderpriority')) AS defaulted,
    coalesce((SELECT string_agg(column_name, ',' ORDER BY column_name) FROM mi WHERE column_name IN {TOP_KEYS} AND column_name IN ('o_custkey', 'o_orderpriority')), '') AS key_modified FROM q""")
def schema_decision_summary(spark, d):
    orders = table(spark, d, "orders").drop("o_orderdate")
    keys = I.key_features(orders, ORDERS_TARGET, 2)
    suggested = {c: x for c, x in R.suggest_roles(orders).items() if c != "o_orderstatus"}
    merged = R.merge_roles(suggested, {"o_custkey": "identifier_ignore", "o_orderpriority": "categorical-ordinal"})
    total, changed, kept, changed_keys = R.decision_summary(merged, keys)
    row = (total, changed, kept, ",".join(sorted(changed_keys)))
    return spark.createDataFrame([row], "total bigint, user_modified bigint, defaulted bigint, key_modified string")


