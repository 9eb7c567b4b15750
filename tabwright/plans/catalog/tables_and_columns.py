"""Sources, sinks, projections and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import columns as X
from ...functions.sizing import lookup, new_path
from ...operators import encoding, importance, scoring, training, whatif
from ...sources import tables
from .base import HOLED_SQL, ORDERS, holed, query, r, rounded, shown, table
from .models import LINEAR_FEATURES, LINEAR_SQL, linear_inputs, linear_model


@query("scan_csv", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS gaps, 'He said "' || o_orderpriority || '", ok' AS said FROM orders""")
def scan_csv(spark, d):
    path = new_path(spark, "csv")
    orders = table(spark, d, "orders").withColumns({
        "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "gaps": F.expr("CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 5 AS STRING) ELSE 'NA' END"),
        "said": F.concat(F.lit('He said "'), "o_orderpriority", F.lit('", ok')),
    })
    tables.write_prepared(orders, path, as_csv=True)
    out = tables.scan_csv(spark, path)
    return out.withColumns({"o_orderkey": F.col("o_orderkey").cast("bigint"), "o_custkey": F.col("o_custkey").cast("bigint"), "gaps": F.col("gaps").cast("bigint")})


@query("scan_csv_line_breaks", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'He said "' || o_orderpriority || '",' || chr(10) || 'then
"left"' WHEN o_orderkey % 7 = 0 THEN 'a 5" disk' ELSE o_orderstatus END AS note, o_totalprice FROM orders""".replace("then\n", "then' || chr(10) || '"))
def scan_csv_line_breaks(spark, d):
    path = new_path(spark, "csv")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('He said "'), "o_orderpriority", F.lit('",\nthen\n"left"'))).when(
        F.col("o_orderkey") % 7 == 0, F.lit('a 5" disk')
    ).otherwise(F.col("o_orderstatus"))
    tables.write_prepared(table(spark, d, "orders").select("o_orderkey", note.alias("note"), "o_totalprice"), path, as_csv=True)
    return tables.scan_csv(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("scan_ml_ready", """SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS is_final FROM orders""")
def scan_ml_ready(spark, d):
    path = new_path(spark, "ready")
    ready = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("is_final"))
    tables.write_prepared(ready, path)
    return tables.scan_ml_ready(spark, path)


@query("sink_prepared", f"""SELECT c_custkey, {r('(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)')} AS c_acctbal,
    CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS c_mktsegment_AUTOMOBILE,
    CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_BUILDING,
    CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS c_mktsegment_FURNITURE,
    CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS c_mktsegment_HOUSEHOLD,
    CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_MACHINERY FROM customer""")
def sink_prepared(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    enc = encoding.fit_encoder(customer, {"c_acctbal": "numeric-continuous", "c_mktsegment": "categorical-nominal"})
    path = new_path(spark, "prepared")
    tables.write_prepared(enc.transform(customer), path)
    return rounded(tables.scan_ml_ready(spark, path))


@query("sink_predictions", f"""{LINEAR_SQL} SELECT 'run-1' AS run_id, l_orderkey, l_linenumber, {r('prediction', 2)} AS prediction FROM scored""")
def sink_predictions(spark, d):
    model, data = linear_model(spark, d), linear_inputs(spark, d)
    path = new_path(spark, "predictions")
    scored = scoring.batch_predict(model, data, LINEAR_FEATURES, ["l_orderkey", "l_linenumber"])
    tables.write_predictions(scored, path, "run-1")
    back = spark.read.parquet(path).where(F.col("run_id") == "run-1")
    return rounded(back.select("run_id", "l_orderkey", "l_linenumber", "prediction"), 2)


@query("sink_report", """SELECT 'row_count' AS item, count(*) AS n FROM orders
    UNION ALL SELECT 'o_totalprice_present', count(o_totalprice) FROM orders""")
def sink_report(spark, d):
    orders = table(spark, d, "orders")
    report = orders.agg(F.count("*").alias("row_count"), F.count("o_totalprice").alias("o_totalprice_present")).unpivot(
        [], ["row_count", "o_totalprice_present"], "item", "n"
    )
    path = new_path(spark, "report")
    tables.write_report(report, path)
    return spark.read.schema("item string, n bigint").json(path)


@query("model_save_load", f"""{LINEAR_SQL} SELECT l_orderkey, l_linenumber, {r('prediction', 2)} AS prediction FROM scored""")
def model_save_load(spark, d):
    from pyspark.ml import PipelineModel

    path = new_path(spark, "model")
    linear_model(spark, d).write().overwrite().save(path)
    back = PipelineModel.load(path)
    scored = scoring.batch_predict(back, linear_inputs(spark, d), LINEAR_FEATURES, ["l_orderkey", "l_linenumber"])
    return rounded(scored.select("l_orderkey", "l_linenumber", "prediction"), 2)


@query("encoder_params_save_load", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r(f'avg({c})')} AS mean, {r(f'stddev_pop({c})')} AS scale FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def encoder_params_save_load(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    enc = encoding.fit_encoder(li, {c: "numeric-continuous" for c in li.columns})
    path = new_path(spark, "params")
    tables.save_params(enc.to_params(spark), path)
    params = tables.load_params(spark, path)
    state = F.from_json("state", "mean double, scale double")
    return rounded(params.select("column_name", state["mean"].alias("mean"), state["scale"].alias("scale")))


@query("row_preview", "SELECT " + ", ".join(
    f"coalesce({shown(c, k) if k != 'datetime' else f'CAST({c} AS VARCHAR)'}, 'nan') AS {c}" for c, k in ORDERS.items()
) + " FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)")
def row_preview(spark, d):
    return tables.row_preview(table(spark, d, "orders"), ["o_orderkey"])


@query("drop_columns", "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def drop_columns(spark, d):
    return table(spark, d, "orders").drop("o_orderkey", "o_totalprice", "o_orderdate")


@query("filter_null_target", f"WITH {HOLED_SQL} SELECT l_orderkey, l_linenumber, l_quantity FROM h WHERE l_quantity IS NOT NULL")
def filter_null_target(spark, d):
    return training.filter_null_target(holed(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


NUMBER_TEXT = [
    "c_custkey",
    "CASE WHEN c_custkey % 5 = 0 THEN concat(CAST(c_custkey AS {text}), '_years') WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS {text}) END AS age",
    "CASE WHEN c_custkey % 50 = 0 THEN '$$$' ELSE concat(CAST(c_custkey AS {text}), '.5') END AS income",
    "c_mktsegment",
]
NUMBER_TEXT_SQL = "n AS (SELECT " + ", ".join(NUMBER_TEXT).format(text="VARCHAR") + " FROM customer)"


def number_text(spark, d):
    return table(spark, d, "customer").selectExpr(*[e.format(text="string") for e in NUMBER_TEXT])


@query("safe_numeric_cast", f"WITH {NUMBER_TEXT_SQL} SELECT c_custkey, TRY_CAST(age AS DOUBLE) AS age, TRY_CAST(income AS DOUBLE) AS income FROM n")
def safe_numeric_cast(spark, d):
    n = number_text(spark, d)
    return n.select("c_custkey", X.safe_number(F.col("age")).alias("age"), X.safe_number(F.col("income")).alias("income"))


@query("numeric_text_detect", f"WITH {NUMBER_TEXT_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r(f'count(TRY_CAST({c} AS DOUBLE)) / count(*)')} AS parsed_share, "
    f"count(TRY_CAST({c} AS DOUBLE)) / count(*) >= 0.8 AS is_numeric FROM n" for c in ("age", "income", "c_mktsegment")))
def numeric_text_detect(spark, d):
    return rounded(importance.numeric_text(number_text(spark, d)))


@query("round_to_integer_cast", """SELECT l_orderkey, CAST(round_even(l_extendedprice / 10, 0) AS BIGINT) AS price,
    CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half, l_discount FROM lineitem""")
def round_to_integer_cast(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_extendedprice / 10 AS price", "l_quantity / 2 AS half", "l_discount")
    return tables.round_to_integers(li, skip=["l_discount"])


@query("fill_constant", f"""WITH {HOLED_SQL} SELECT l_orderkey, coalesce(l_quantity, 0) AS l_quantity,
    coalesce(l_returnflag, '_UNKNOWN_') AS l_returnflag FROM h""")
def fill_constant(spark, d):
    return holed(spark, d).select("l_orderkey", "l_quantity", "l_returnflag").fillna({"l_quantity": 0.0, "l_returnflag": "_UNKNOWN_"})


@query("feature_align", f"""WITH {HOLED_SQL} SELECT l_orderkey, l_linenumber, CAST(0 AS DOUBLE) AS l_absent,
    coalesce(l_quantity, 0) AS l_quantity, coalesce(TRY_CAST(l_returnflag AS DOUBLE), 0) AS l_returnflag,
    coalesce(l_discount, 0) AS l_discount FROM h""")
def feature_align(spark, d):
    return scoring.feature_align(holed(spark, d), ["l_absent", "l_quantity", "l_returnflag", "l_discount"], ["l_orderkey", "l_linenumber"])


@query("predicate_in_set", "SELECT c_custkey, lower(c_mktsegment) IN ('building', 'machinery') AS in_set FROM customer")
def predicate_in_set(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.word_in(F.col("c_mktsegment"), ["building", "machinery"]).alias("in_set"))


@query("lookup_map", f"""SELECT o.o_orderkey, o.o_orderstatus, {r('m.mean_price', 4)} AS mean_price FROM orders o LEFT JOIN
    (SELECT o_orderstatus, avg(o_totalprice) AS mean_price FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) m USING (o_orderstatus)""")
def lookup_map(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    params = orders.where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").alias("n"))
    return rounded(lookup(orders, params, "o_orderstatus", weight="n").select("o_orderkey", "o_orderstatus", "mean_price"), 4)


@query("column_concat", """SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
    CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
    CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek FROM orders""")
def column_concat(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", *X.date_parts(F.col("o_orderdate"), "o_orderdate"))


def order_scenarios(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return whatif.scenarios(orders, {
        "base": {},
        "urgent": {"o_orderpriority": F.lit("1-URGENT")},
        "double": {"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("F")},
    })


@query("scenario_pair_diff", """
    SELECT o_orderkey, 'urgent' AS scenario, CASE WHEN o_orderpriority <> '1-URGENT'
        THEN 'o_orderpriority: 1-URGENT vs ' || o_orderpriority ELSE '' END AS differences FROM orders
    UNION ALL SELECT o_orderkey, 'double', CASE WHEN o_orderstatus <> 'F' THEN 'o_orderstatus: F vs ' || o_orderstatus ELSE '' END FROM orders""")
def scenario_pair_diff(spark, d):
    return whatif.scenario_pair_diff(order_scenarios(spark, d), ["o_orderkey"], ["o_orderpriority", "o_orderstatus"], ["base", "urgent", "double"])


@query("display_name", """SELECT p_partkey, list_aggregate(list_transform(list_filter(string_split(
    replace(replace(trim(p_type || '_' || p_name), '_', ' '), '-', ' '), ' '), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS shown FROM part""")
def display_name(spark, d):
    return table(spark, d, "part").select("p_partkey", X.display_name(F.concat_ws("_", "p_type", "p_name")).alias("shown"))


