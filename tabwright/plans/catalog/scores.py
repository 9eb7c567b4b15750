"""Scoring, what-if analysis, input forms and run history."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ...functions.columns import feature_category
from ...functions.sizing import spread
from ...operators import explaining, forms, runlog, scoring as S, whatif as W
from .base import LINEITEM, PART, PSEUDO, query, r, rounded, table, union
from .models import LINEAR_FEATURES, LINEAR_SQL, linear_inputs, linear_model
from .profiles import variation_sql

KEYS = ["l_orderkey", "l_linenumber"]
Z = NormalDist().inv_cdf(0.975)
SCORED_SQL = f"p AS (SELECT *, {PSEUDO} AS prediction FROM lineitem)"


def scored(spark, d):
    return table(spark, d, "lineitem").withColumn("prediction", F.expr(PSEUDO))


@query("batch_predict", f"{LINEAR_SQL} SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, {r('prediction', 2)} AS prediction FROM scored")
def batch_predict(spark, d):
    return rounded(S.batch_predict(linear_model(spark, d), linear_inputs(spark, d), LINEAR_FEATURES, KEYS), 2)


@query("prediction_summary", f"""WITH {SCORED_SQL} SELECT 'regression' AS task, 'all' AS prediction_class, count(*) AS n, {r('min(prediction)', 2)} AS min, {r('max(prediction)', 2)} AS max,
    {r('avg(prediction)', 4)} AS mean, {r('stddev_samp(prediction)', 4)} AS std FROM p
    UNION ALL SELECT 'classification', l_returnflag, count(*), NULL, NULL, NULL, NULL FROM p GROUP BY l_returnflag""")
def prediction_summary(spark, d):
    p = scored(spark, d)
    a = S.prediction_summary(p, "prediction", "regression").select(
        F.lit("regression").alias("task"), F.lit("all").alias("prediction_class"), "n", "min", "max", "mean", "std")
    none = [F.lit(None).cast("double").alias(k) for k in ("min", "max", "mean", "std")]
    b = S.prediction_summary(p, "l_returnflag", "classification").select(F.lit("classification").alias("task"), "prediction_class", "n", *none)
    return rounded(a.unionByName(b), 4, min=2, max=2)


HALF = "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE " + PSEUDO + " END"


@query("batch_summary", f"""SELECT count(*) AS total, count(q) AS successful, count(*) - count(q) AS failed, {r('min(q)', 2)} AS min, {r('max(q)', 2)} AS max,
    {r('avg(q)', 4)} AS mean, {r('stddev_pop(q)', 4)} AS std FROM (SELECT {HALF} AS q FROM lineitem)""")
def batch_summary(spark, d):
    p = table(spark, d, "lineitem").selectExpr(f"{HALF} AS q")
    return rounded(S.batch_summary(p, "q"), 4, min=2, max=2)


@query("batch_error_rows", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'balance is not a number' END AS error,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS DOUBLE) * 2 END AS prediction FROM customer""")
def batch_error_rows(spark, d):
    raw = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_custkey AS string) END AS balance")
    checked = S.batch_error_rows(raw, ["balance"])
    value = F.when(F.col("error").isNull(), F.col("balance").try_cast("double") * 2)
    return checked.select("c_custkey", "error", value.alias("prediction"))


@query("prediction_interval", f"""WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, {r('prediction', 6)} AS prediction, {r(f'prediction - {Z!r} * abs(prediction) * 0.1', 6)} AS lower_bound,
    {r(f'prediction + {Z!r} * abs(prediction) * 0.1', 6)} AS upper_bound, CAST(0.95 AS DOUBLE) AS confidence_level, {r('abs(prediction) * 0.1', 6)} AS std_error FROM p""")
def prediction_interval(spark, d):
    p = scored(spark, d).select(*KEYS, "prediction")
    return rounded(S.prediction_interval(p, "prediction"), 6)


WEIGHTS = {"l_quantity": 37.5, "l_extendedprice": 0.9, "l_discount": -1000.0, "l_tax": 0.0}
CONTRIBUTIONS = union([f"SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, '{c}' AS feature, {c} AS feature_value, {w} * {c} AS contribution FROM lineitem" for c, w in WEIGHTS.items()])


@query("feature_contributions", f"""SELECT l_orderkey, l_linenumber, feature, feature_value, {r('contribution', 4)} AS contribution,
    CASE WHEN contribution > 0 THEN 'positive' WHEN contribution < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM ({CONTRIBUTIONS})""")
def feature_contributions(spark, d):
    return rounded(S.feature_contributions(table(spark, d, "lineitem"), KEYS, WEIGHTS), 4)


ORDER_WEIGHTS = {"o_totalprice": 0.01, "o_custkey": 2.0, "o_orderkey": -0.5}
ORDER_PARTS = union([f"SELECT o_orderkey AS k, '{c}' AS feature, {w} * {c} AS contribution FROM orders" for c, w in ORDER_WEIGHTS.items()])


@query("top_contributions", f"""SELECT o_orderkey, CAST(rank AS INTEGER) AS rank, feature, {r('contribution', 4)} AS contribution FROM (
    SELECT k AS o_orderkey, row_number() OVER (PARTITION BY k ORDER BY abs(contribution) DESC, feature) AS rank, feature, contribution FROM ({ORDER_PARTS})) WHERE rank <= 2""")
def top_contributions(spark, d):
    return rounded(S.top_contributions(table(spark, d, "orders"), ["o_orderkey"], ORDER_WEIGHTS, 2), 4)


@query("enhanced_prediction", f"""{LINEAR_SQL} SELECT l_orderkey, l_linenumber, {r('prediction', 2)} AS prediction, {r(f'prediction - {Z!r} * abs(prediction) * 0.1', 2)} AS lower_bound,
    {r(f'prediction + {Z!r} * abs(prediction) * 0.1', 2)} AS upper_bound,
    CASE WHEN abs(b1 * l_extendedprice) >= abs(b2 * l_discount) AND abs(b1 * l_extendedprice) > 0 THEN 'l_extendedprice,l_discount' ELSE 'l_discount,l_extendedprice' END AS top_features FROM scored""")
def enhanced_prediction(spark, d):
    model = linear_model(spark, d)
    weights = {x["feature"]: x["score"] for x in explaining.model_importance(model, LINEAR_FEATURES).collect()}
    out = S.enhanced_prediction(model.transform(linear_inputs(spark, d)), KEYS, LINEAR_FEATURES, weights, "regression")
    return rounded(out.drop("input_features"), 2)


def scenario_rows(spark, d):
    li = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = W.scenarios(li, {"base": {}, "cheaper": {"o_totalprice": F.col("o_totalprice") * 0.8}, "dearer": {"o_totalprice": F.col("o_totalprice") * 1.5}})
    return out.withColumn("prediction", F.col("o_totalprice") * 2 + F.col("o_custkey"))


SCENARIO_SQL = union([f"SELECT o_orderkey, '{n}' AS scenario, (o_totalprice * {m}) * 2 + o_custkey AS prediction FROM orders" for n, m in (("base", 1.0), ("cheaper", 0.8), ("dearer", 1.5))])


@query("scenario_compare", f"""SELECT o_orderkey, count(*) AS n, {r('stddev_pop(prediction)', 4)} AS std, {r('max(prediction) - min(prediction)', 4)} AS range,
    {r('stddev_pop(prediction) / avg(prediction)')} AS cv, string_agg(scenario, '>' ORDER BY prediction DESC, scenario) AS ranking FROM ({SCENARIO_SQL}) GROUP BY 1""")
def scenario_compare(spark, d):
    return rounded(W.scenario_compare(scenario_rows(spark, d), ["o_orderkey"], "prediction", ["base", "cheaper", "dearer"]), 4, cv=6)


GRID = [1000.0, 20000.0, 40000.0, 60000.0, 80000.0, 100000.0]


@query("sensitivity_sweep", f"""{LINEAR_SQL} SELECT l_orderkey, l_linenumber, grid_value, {r('my + b1 * (grid_value - m1) + b2 * (l_discount - m2)', 2)} AS prediction
    FROM scored, (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS grid_value)""")
def sensitivity_sweep(spark, d):
    model = linear_model(spark, d)
    return rounded(W.sensitivity_sweep(model, spread(linear_inputs(spark, d), *KEYS), KEYS, "l_extendedprice", GRID), 2)


SWEEP_PREDICTION = "grid_value * (o_custkey % 7 - 3) + abs(grid_value - 3) * 50 + o_orderkey"


@query("sweep_monotonicity", f"""WITH s AS (SELECT o_orderkey, grid_value, {SWEEP_PREDICTION} AS prediction FROM orders, (SELECT unnest([1, 2, 3, 4, 5, 6]::DOUBLE[]) AS grid_value)),
    pr AS (SELECT a.o_orderkey, avg(CAST(b.prediction > a.prediction AS DOUBLE)) * 100 AS rising FROM s a JOIN s b ON a.o_orderkey = b.o_orderkey AND a.grid_value < b.grid_value GROUP BY 1),
    g AS (SELECT o_orderkey, (max(prediction) - min(prediction)) / avg(prediction) * 100 AS rp, CASE WHEN stddev_pop(prediction) > 0 THEN corr(grid_value, prediction) END AS r FROM s GROUP BY 1)
    SELECT o_orderkey, {r('rising', 4)} AS rising_pct, {r('rp', 4)} AS range_pct, {r('g.r', 4)} AS r FROM pr JOIN g USING (o_orderkey)""")
def sweep_monotonicity(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(0.0).alias("x"))
    swept = W.sweep(base, "x", [1, 2, 3, 4, 5, 6]).withColumn("prediction", F.expr(SWEEP_PREDICTION))
    return rounded(W.sweep_monotonicity(swept, ["o_orderkey"], range(1, 7)), 4)


@query("prediction_variation", f"""WITH {SCORED_SQL} SELECT {r('avg(prediction)', 4)} AS mean, {r('stddev_pop(prediction)', 4)} AS std,
    {r('stddev_pop(prediction) / avg(prediction)')} AS cv, stddev_pop(prediction) / avg(prediction) >= 0.15 AS varies FROM p""")
def prediction_variation(spark, d):
    return rounded(S.prediction_variation(scored(spark, d), "prediction"), 4, cv=6)


@query("target_scale_check", f"SELECT {r('avg(o_totalprice)', 4)} AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, avg(o_totalprice) BETWEEN 100000 AND 300000 AS in_range FROM orders")
def target_scale_check(spark, d):
    return rounded(S.target_scale_check(table(spark, d, "orders"), "o_totalprice", 100000, 300000), 4)


# -- input forms -------------------------------------------------------------

FORM_ROLES = {"p_name": "categorical-nominal", "p_brand": "categorical-nominal", "p_type": "categorical-ordinal", "p_size": "numeric-discrete", "p_partkey": "numeric-discrete"}
FORM_NUMERIC = ["p_partkey", "p_size"]
FORM_TEXT = ["p_name", "p_brand", "p_type"]


@query("input_schema", union([
    f"SELECT '{c}' AS feature, 'numeric' AS input_type, '{FORM_ROLES[c]}' AS role, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"{r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, CAST(NULL AS BIGINT) AS n_options, CAST(NULL AS VARCHAR) AS default_option FROM part" for c in FORM_NUMERIC] + [
    f"SELECT '{c}', 'categorical', '{FORM_ROLES[c]}', NULL, NULL, NULL, NULL, count(DISTINCT {c}), min({c}) FROM part" for c in FORM_TEXT]))
def input_schema(spark, d):
    return rounded(forms.input_schema(table(spark, d, "part"), "p_retailprice", FORM_ROLES), 4)


def step_sql(extra: int, c: str, source: str) -> str:
    """Step of a hundredth of the range, rounded by its leading digit."""
    s = f"((max({c}) - min({c})) / 100.0)"
    digits = f"CAST(greatest(0, -floor(log10({s})) + {extra}) AS INTEGER)"
    return f"CASE WHEN max({c}) = min({c}) THEN 1.0 WHEN {s} < 1 THEN round(CAST({s} AS DOUBLE), {digits}) ELSE greatest(1, round_even(CAST({s} AS DOUBLE), 0)) END"


def slider_sql(c: str, source: str) -> str:
    s = f"((max({c}) - min({c})) / 100.0)"
    fmt = f"CASE WHEN max({c}) > min({c}) AND {s} < 1 THEN '.' || CAST(CAST(greatest(0, -floor(log10({s})) + 1) AS INTEGER) AS VARCHAR) || 'f' ELSE '.0f' END"
    return (
        f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {r(f'avg({c})', 4)} AS default_value, {r(step_sql(1, c, source))} AS step, "
        f"{r(f'median({c})', 4)} AS suggested, {fmt} AS display_format, {r(f'stddev_samp({c})', 4)} AS std, {r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}, 0.75)', 4)} AS q75 FROM {source}"
    )


NUMERIC = [c for c, k in LINEITEM.items() if k in ("int", "float")]


@query("slider_config", union([slider_sql(c, "lineitem") for c in NUMERIC]))
def slider_config(spark, d):
    return rounded(forms.slider_config(table(spark, d, "lineitem")), 4, step=6)


@query("slider_step", union([f"SELECT '{c}' AS feature, {r(step_sql(0, c, 'lineitem'))} AS form_step, {r(step_sql(1, c, 'lineitem'))} AS slider_step FROM lineitem" for c in NUMERIC]))
def slider_step(spark, d):
    from ...operators.profiling import numeric_range_stats

    ranges = numeric_range_stats(table(spark, d, "lineitem")).collect()  # one row per column
    rows = [(x["column_name"], forms.form_step(x["min"], x["max"]), forms.slider_step(x["min"], x["max"])[0]) for x in ranges]
    return rounded(spark.createDataFrame(rows, "feature string, form_step double, slider_step double"))


IMPORTANCE = {"p_size": 0.4, "p_partkey": 0.9, "p_brand": 0.2, "p_type": 0.1, "p_name": 0.05}


def importance_table(spark):
    return spark.createDataFrame(list(IMPORTANCE.items()), "feature string, score double")


def enhanced_sql() -> str:
    rank = {c: i + 1 for i, (c, _) in enumerate(sorted(IMPORTANCE.items(), key=lambda x: -x[1]))}
    parts = []
    for c in FORM_NUMERIC:
        s = step_sql(0, c, "part")
        parts.append(
            f"SELECT '{c}' AS feature, 'numeric' AS input_type, '{feature_category(c)}' AS category, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
            f"{r(f'avg({c})', 4)} AS default_value, {r(s)} AS step, {r(f'median({c})', 4)} AS suggested, CASE WHEN {s} < 1 THEN '.3f' ELSE '.0f' END AS display_format, "
            f"{r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'median({c})', 4)} AS median, {r(f'quantile_cont({c}, 0.75)', 4)} AS q75, CAST(NULL AS BIGINT) AS n_options, "
            f"CAST(NULL AS VARCHAR) AS default_option, {r(f'corr({c}, p_retailprice)', 4)} AS r, CAST({rank[c]} AS INTEGER) AS importance_rank, CAST({IMPORTANCE[c]} AS DOUBLE) AS importance_score, 'range' AS rule FROM part")
    for c in FORM_TEXT:
        common = f"(SELECT {c} FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
        parts.append(
            f"SELECT '{c}', 'categorical', '{feature_category(c)}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}), {common}, NULL, "
            f"CAST({rank[c]} AS INTEGER), CAST({IMPORTANCE[c]} AS DOUBLE), 'options' FROM part")
    return union(parts)


@query("enhanced_input_schema", enhanced_sql())
def enhanced_input_schema(spark, d):
    return rounded(forms.enhanced_input_schema(table(spark, d, "part"), "p_retailprice", FORM_ROLES, importance_table(spark)), 4, step=6)


FOCUS = {c: k for c, k in PART.items() if c != "p_retailprice"}


@query("ranked_input_schema", f"""WITH s AS ({variation_sql('part', FOCUS)}), n AS (SELECT *, score / (SELECT max(score) FROM s) AS importance FROM s),
    k AS (SELECT *, row_number() OVER (ORDER BY importance DESC, column_name) AS rank FROM n)
    SELECT column_name AS feature, {r('score')} AS score, {r('importance')} AS importance, CASE WHEN importance >= 0.7 THEN 'high' WHEN importance >= 0.3 THEN 'medium' ELSE 'low' END AS tier,
    CAST(rank AS INTEGER) AS rank, CASE column_name {' '.join(f"WHEN '{c}' THEN '{feature_category(c)}'" for c in FOCUS)} END AS category, rank <= 10 AS in_focus FROM k""")
def ranked_input_schema(spark, d):
    return rounded(forms.ranked_input_schema(table(spark, d, "part"), "p_retailprice"))


@query("input_range_check", """SELECT o_orderkey, violations FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice NOT BETWEEN 20000 AND 450000 THEN 'o_totalprice' END,
    CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'o_orderpriority' END) AS violations FROM orders) WHERE violations <> ''""")
def input_range_check(spark, d):
    return S.input_range_check(
        table(spark, d, "orders"), ["o_orderkey"], {"o_totalprice": (20000, 450000)}, {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}
    )


# -- run history: user_id stands for the run, event_type for what happened ----

STAGE_OF = "CASE event_type WHEN 'signup' THEN 'ingest' WHEN 'view' THEN 'schema' WHEN 'click' THEN 'validation' WHEN 'purchase' THEN 'prep' ELSE 'automl' END"
STATUS_OF = "CASE WHEN event_type = 'error' AND value > 100 THEN 'failed' WHEN value > 300 THEN 'completed' WHEN value > 50 THEN 'running' ELSE 'pending' END"
LOG_EXPRS = ["CONCAT('run-', user_id) AS run_id", "ts", "event_id", "value", f"{STAGE_OF} AS stage", f"{STATUS_OF} AS status"]
LOG_SQL = f"log AS (SELECT {', '.join(LOG_EXPRS)} FROM events)"
LATEST_SQL = f"""{LOG_SQL}, latest AS (SELECT run_id, stage, status, n_events FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn,
    count(*) OVER (PARTITION BY run_id) AS n_events FROM log) WHERE rn = 1)"""
PROGRESS = "CASE stage WHEN 'ingest' THEN 0 WHEN 'schema' THEN 10 WHEN 'validation' THEN 30 WHEN 'prep' THEN 50 WHEN 'automl' THEN 70 WHEN 'explain' THEN 90 END"


def log(spark, d):
    return table(spark, d, "events").selectExpr(*LOG_EXPRS)


@query("event_log_scan", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, CAST(user_id AS VARCHAR) AS run_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, event_type AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def event_log_scan(spark, d):
    from ...functions.sizing import new_path
    from ...sources.tables import event_log_scan as scan

    path = new_path(spark, "log")
    lines = table(spark, d, "events").select(F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"),
        F.lit("prep").alias("stage"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("event"),
        F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("id"), F.col("event_id").cast("string"))).alias("event_data"),
    )).alias("value"))
    lines.write.text(path)
    read = scan(spark, path)
    return read.select(
        F.col("event_data")["id"].cast("bigint").alias("event_id"), "severity", "run_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event", F.col("event_data")["k"].cast("bigint").alias("k"))


@query("run_latest_status", f"WITH {LATEST_SQL} SELECT * FROM latest")
def run_latest_status(spark, d):
    return runlog.run_latest_status(log(spark, d))


@query("stage_progress", f"""WITH {LATEST_SQL} SELECT *, CAST(CASE WHEN status IN ('completed', 'failed') THEN 100 ELSE {PROGRESS} END AS INTEGER) AS progress_pct FROM latest""")
def stage_progress(spark, d):
    return runlog.stage_progress(runlog.run_latest_status(log(spark, d)))


@query("stage_state", f"""WITH {LATEST_SQL}, st AS (SELECT unnest(['ingest', 'schema', 'validation', 'prep', 'automl', 'explain']) AS name, unnest([1, 2, 3, 4, 5, 6]) AS pos)
    SELECT run_id, st.name AS stage, CASE WHEN st.pos < cur.pos THEN 'completed' WHEN st.pos > cur.pos THEN 'pending' WHEN status IN ('completed', 'failed') THEN status ELSE 'running' END AS state
    FROM latest JOIN st cur ON cur.name = latest.stage, st""")
def stage_state(spark, d):
    return runlog.stage_states(runlog.run_latest_status(log(spark, d)))


@query("list_runs", f"WITH {LOG_SQL} SELECT DISTINCT run_id FROM log")
def list_runs(spark, d):
    return runlog.list_runs(log(spark, d))


METRIC_SQL = f"""m AS (SELECT run_id, count(*) AS events, count(*) FILTER (status = 'failed') AS errors,
    count(*) FILTER (stage = 'validation' AND value >= 50) * 100.0 / nullif(count(*) FILTER (stage = 'validation'), 0) AS validation_pct,
    sum(value) FILTER (stage = 'prep') AS rows_changed, max(value) FILTER (stage = 'automl') AS best_metric FROM log GROUP BY 1)"""
METRIC_COLUMNS = f"events, errors, {r('validation_pct', 4)} AS validation_pct, {r('rows_changed', 4)} AS rows_changed, best_metric"


@query("run_metric_summary", f"WITH {LOG_SQL}, {METRIC_SQL} SELECT run_id, {METRIC_COLUMNS} FROM m")
def run_metric_summary(spark, d):
    return rounded(runlog.run_metric_summary(log(spark, d)), 4)


@query("run_results_rollup", f"""WITH {LATEST_SQL}, {METRIC_SQL} SELECT l.run_id, stage, status, n_events,
    CAST(CASE WHEN status IN ('completed', 'failed') THEN 100 ELSE {PROGRESS} END AS INTEGER) AS progress_pct, {METRIC_COLUMNS} FROM latest l LEFT JOIN m ON l.run_id = m.run_id""")
def run_results_rollup(spark, d):
    entries = log(spark, d)
    latest = runlog.stage_progress(runlog.run_latest_status(entries))
    return rounded(runlog.run_results_rollup([latest, runlog.run_metric_summary(entries)]), 4)


