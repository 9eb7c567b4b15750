"""Encoders and engineered features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.fixed_values import ENGLISH_STOP_WORDS
from ...functions.sizing import spread
from ...operators import encoding as E, roles as R
from .base import HOLED_SQL, holed, query, r, rounded, table


@query("encode_target_binary01", """SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 2 AS INTEGER) AS flag,
    CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS l_linestatus FROM lineitem""")
def encode_target_binary01(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_linenumber % 2 AS DOUBLE) AS flag", "l_linestatus")
    steps = [
        E.fit_target(li, R.Target("flag", "classification", "binary_01")),
        E.fit_target(li, R.Target("l_linestatus", "classification", "binary_text_labels")),
    ]
    return E.Encoder(steps).transform(li)


@query("encode_target_int", "SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS grade FROM orders")
def encode_target_int(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 5 AS DOUBLE) AS grade")
    return E.Encoder([E.fit_target(o, R.Target("grade", "classification", "multiclass_int_labels"))]).transform(o)


@query("encode_target_signed", "SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS sign FROM orders")
def encode_target_signed(spark, d):
    """Labels -10, 0 and 7 become classes in their order."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN -10 WHEN 1 THEN 0 ELSE 7 END AS sign")
    return E.Encoder([E.fit_target(o, R.Target("sign", "classification", "multiclass_int_labels"))]).transform(o)


@query("encode_target_label", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders")
def encode_target_label(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return E.Encoder([E.fit_target(o, R.Target("o_orderpriority", "classification", "multiclass_text_labels"))]).transform(o)


@query("encode_target_float", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def encode_target_float(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return E.Encoder([E.fit_target(o, R.Target("o_custkey", "regression", "numeric_continuous"))]).transform(o)


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_zero"]


@query("standard_scale", f"""WITH z AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax * 0 AS l_zero FROM lineitem),
    s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}' for c in SCALED)} FROM z)
    SELECT l_orderkey, l_linenumber, {', '.join(f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in SCALED)} FROM z, s""")
def standard_scale(spark, d):
    z = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax * 0 AS l_zero")
    return rounded(E.standard_scale(z, SCALED))


@query("one_hot", f"""WITH {HOLED_SQL} SELECT l_orderkey, l_linenumber, {', '.join(
    f"CAST(coalesce(l_returnflag = '{v}', false) AS INTEGER) AS l_returnflag_{v}" for v in 'ANR')}, {', '.join(
    f"CAST(l_linenumber = {v} AS INTEGER) AS l_number_{v}" for v in range(1, 8))} FROM h""")
def one_hot(spark, d):
    h = holed(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_linenumber").alias("l_number"))
    return E.one_hot(h, ["l_returnflag", "l_number"])


@query("one_hot_rows", """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS position,
    CAST(o_custkey AS VARCHAR) AS value, CAST(1 AS INTEGER) AS hot FROM orders""")
def one_hot_rows(spark, d):
    return E.one_hot_rows(table(spark, d, "orders"), ["o_orderkey"], "o_custkey")


PLACES = "size int, indices array<int>, values array<double>"


def places(vector: str):
    """The places of a sparse vector that hold something."""
    return F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), f"v struct<{PLACES}>")["v"]


@query("encode_pipeline_wide", f"""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, count(DISTINCT o_custkey) AS k FROM orders)
    SELECT o_orderkey, {r('(o_totalprice - m) / sd')} AS o_totalprice, CAST(k AS INTEGER) AS size, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS place,
    CAST(dense_rank() OVER (ORDER BY o_orderdate) - 1 AS INTEGER) AS o_orderdate FROM orders, s""")
def encode_pipeline_wide(spark, d):
    """Every customer is a feature: a sparse 0/1 vector through the fitted encoder."""
    o = spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderdate")
    roles = {"o_totalprice": "numeric-continuous", "o_custkey": "categorical-nominal", "o_orderdate": "categorical-ordinal"}
    out = E.fit_encoder(o, roles, wide_levels=0).transform(o).withColumn("at", places("o_custkey"))
    return rounded(out.select("o_orderkey", "o_totalprice", F.col("at.size").alias("size"), F.get("at.indices", F.lit(0)).alias("place"), "o_orderdate"))


@query("interaction_features_wide", """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS place, o_totalprice AS value FROM orders""")
def interaction_features_wide(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = E.interaction_features(o, "o_totalprice", "o_custkey", wide_levels=0).withColumn("at", places("o_totalprice_x_o_custkey"))
    return out.select("o_orderkey", F.get("at.indices", F.lit(0)).alias("place"), F.get("at.values", F.lit(0)).alias("value"))


@query("interaction_rows", """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS position,
    CAST(o_custkey AS VARCHAR) AS value, o_totalprice AS hot FROM orders""")
def interaction_rows(spark, d):
    return E.one_hot_rows(table(spark, d, "orders"), ["o_orderkey"], "o_custkey", "o_totalprice")


@query("ordinal_codes", f"""WITH {HOLED_SQL}, k AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code FROM
    (SELECT DISTINCT l_returnflag FROM h WHERE l_returnflag IS NOT NULL)) SELECT l_orderkey, l_linenumber, h.l_returnflag, coalesce(code, -1) AS code
    FROM h LEFT JOIN k ON h.l_returnflag = k.l_returnflag""")
def ordinal_codes(spark, d):
    h = holed(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag")
    return E.ordinal_codes(h, "l_returnflag", "code").select("l_orderkey", "l_linenumber", "l_returnflag", "code")


@query("encode_boolean", "SELECT l_orderkey, l_linenumber, CAST(l_tax > 0.03 AS INTEGER) AS taxed, CAST(l_orderkey % 2 AS INTEGER) AS odd FROM lineitem")
def encode_boolean(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_tax > 0.03 AS taxed", "CAST(l_orderkey % 2 AS DOUBLE) AS odd")
    return E.fit_encoder(li, {"taxed": "boolean", "odd": "boolean"}).transform(li)


TEXT_FLAG = """CASE c_custkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'enabled'
    WHEN 5 THEN 'maybe' WHEN 6 THEN 'perhaps' ELSE NULL END"""


@query("encode_text_boolean", f"""SELECT c_custkey, CASE WHEN lower(t) IN ('yes', 'true', 'enabled') THEN 1 WHEN lower(t) IN ('no', '0') THEN 0
    WHEN t = 'maybe' THEN 0 WHEN t = 'perhaps' THEN 1 ELSE 0 END AS answer FROM (SELECT c_custkey, {TEXT_FLAG} AS t FROM customer)""")
def encode_text_boolean(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", f"{TEXT_FLAG} AS answer")
    return E.fit_encoder(c, {"answer": "boolean"}).transform(c)


def parts_sql(c):
    return (f"CAST(year({c}) AS INTEGER) AS {c}_year, CAST(month({c}) AS INTEGER) AS {c}_month, "
            f"CAST(day({c}) AS INTEGER) AS {c}_day, CAST(isodow({c}) - 1 AS INTEGER) AS {c}_dayofweek")


@query("datetime_parts", f"SELECT l_orderkey, l_linenumber, {parts_sql('l_shipdate')} FROM lineitem")
def datetime_parts(spark, d):
    return E.datetime_parts(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate")


def tfidf_sql(source, key, text, terms=50):
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
    return f"""tok AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source}),
    voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM (SELECT term FROM tok WHERE term NOT IN ({words}) GROUP BY term ORDER BY count(*) DESC, term LIMIT {terms})),
    tf AS (SELECT {key}, term, count(*) AS n FROM tok JOIN voc USING (term) GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    w AS (SELECT {key}, term, n * idf AS w FROM tf JOIN idf USING (term)),
    weights AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM w)"""


@query("tfidf_50", f"WITH {tfidf_sql('documents', 'doc_id', 'text')} SELECT doc_id, term, {r('weight')} AS weight FROM weights")
def tfidf_50(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rounded(E.tfidf_weights(docs, "text", ["doc_id"]))


ENCODE_ROLES = {
    "o_totalprice": "numeric-continuous", "o_orderstatus": "categorical-nominal", "o_orderpriority": "categorical-ordinal",
    "o_orderdate": "datetime", "o_big": "boolean", "o_custkey": "identifier_ignore", "o_note": "text",
}
ENCODE_EXPRS = [
    "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice > 250000 AS o_big",
    "o_custkey", "concat(o_orderpriority, ' ', o_orderstatus, o_orderstatus) AS o_note", "o_orderkey % 2 AS o_target",
]


@query("encode_pipeline", f"""WITH o AS (SELECT {', '.join(ENCODE_EXPRS)} FROM orders), {tfidf_sql('o', 'o_orderkey', 'o_note', 4)},
    wide AS (SELECT o_orderkey, {', '.join(f"coalesce(max(CASE WHEN i = {i} THEN weight END), 0) AS t{i}" for i in range(4))} FROM weights JOIN voc USING (term) GROUP BY 1)
    SELECT o.o_orderkey, {r('(o_totalprice - (SELECT avg(o_totalprice) FROM o)) / (SELECT stddev_pop(o_totalprice) FROM o)')} AS o_totalprice,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority, CAST(o_big AS INTEGER) AS o_big, CAST(o_target AS INTEGER) AS o_target,
    {', '.join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS o_orderstatus_{v}" for v in 'FOP')}, {parts_sql('o_orderdate')},
    {', '.join(f"{r(f'coalesce(t{i}, 0)')} AS o_note_tfidf_{i}" for i in range(4))}
    FROM o LEFT JOIN wide ON o.o_orderkey = wide.o_orderkey""")
def encode_pipeline(spark, d):
    o = spread(table(spark, d, "orders"), "o_orderkey").selectExpr(*ENCODE_EXPRS)
    return rounded(E.fit_encoder(o, ENCODE_ROLES, R.Target("o_target", "classification", "binary_01"), terms=4).transform(o))


@query("interaction_features", "SELECT o_orderkey, " + ", ".join(
    f"o_totalprice * CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_totalprice_x_{v.replace(' ', '_')}\""
    for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def interaction_features(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return E.interaction_features(o, "o_totalprice", "o_orderpriority").drop("o_totalprice", "o_orderpriority")


@query("target_mean_encode", f"""SELECT o_orderkey, o_custkey, {r('avg(o_totalprice) OVER (PARTITION BY o_custkey)', 7)} AS mean_price FROM orders""")
def target_mean_encode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(E.target_mean_encode(o, "o_custkey", "o_totalprice", "mean_price"), 7).select("o_orderkey", "o_custkey", "mean_price")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("encoder_comparison", f"""WITH t AS (SELECT o_totalprice AS y, o_orderpriority AS g, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders),
    c AS (SELECT abs(corr(m, y)) AS a, greatest({', '.join(f"abs(corr(CAST(g = '{v}' AS INTEGER), y))" for v in PRIORITIES)}) AS b FROM t)
    SELECT {r('a')} AS target_encoding_r, {r('b')} AS best_one_hot_r, {r('a / b')} AS ratio FROM c""")
def encoder_comparison(spark, d):
    return rounded(E.encoder_comparison(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@query("encode_input_row", f"""WITH n AS (SELECT c_custkey, c_acctbal + 10 AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'SHIPPING' ELSE c_mktsegment END AS c_mktsegment FROM customer),
    s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer)
    SELECT c_custkey, {r('(c_acctbal - m) / sd')} AS c_acctbal, {', '.join(
    f"CAST(c_mktsegment = '{v}' AS INTEGER) AS c_mktsegment_{v}" for v in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM n, s""")
def encode_input_row(spark, d):
    """New rows go through the encoder fitted on the old ones; an unseen value is all zeros."""
    seen = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    encoder = E.fit_encoder(seen, {"c_acctbal": "numeric-continuous", "c_mktsegment": "categorical-nominal"})
    new = seen.select(
        "c_custkey", (F.col("c_acctbal") + 10).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 3 == 0, "SHIPPING").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return rounded(encoder.transform(new))


