"""Profiles, frequencies, correlations and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.sizing import spread
from ...operators import cleaning, correlation as C, frequencies as Q, heavy, importance as I, profiling as P
from .base import (
    HOLED, HOLED_SQL, LINEITEM, PART, holed, query, r, rounded, shown, table, union,
)

NUMERIC = [c for c, k in LINEITEM.items() if k in ("int", "float")]


def nulls(c):
    return f"count(*) FILTER ({c} IS NULL)"


@query("profile_table", union([
    f"SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) AS n_rows, count({c}) AS non_null, "
    f"{r(f'{nulls(c)} * 100.0 / count(*)', 4)} AS missing_pct FROM h" for c, k in HOLED.items()], f"WITH {HOLED_SQL}"))
def profile_table(spark, d):
    return rounded(P.profile_table(holed(spark, d)), 4).select("column_name", "dtype", "n_rows", "non_null", "missing_pct")


@query("ingest_stats", f"""WITH {HOLED_SQL} SELECT count(*) AS n_rows, CAST({len(HOLED)} AS BIGINT) AS n_columns,
    {' + '.join(nulls(c) for c in HOLED)} AS missing_cells, '{','.join(f'{c}:{k}' for c, k in HOLED.items())}' AS column_types FROM h""")
def ingest_stats(spark, d):
    return P.ingest_stats(holed(spark, d))


def statistics_sql(source, kinds):
    return [
        f"SELECT '{c}' AS column_name, '{k}' AS dtype, count(DISTINCT {c}) AS n_unique, {nulls(c)} AS n_missing, "
        f"{r(f'{nulls(c)} * 100.0 / count(*)', 1)} AS missing_pct, "
        f"(SELECT coalesce(string_agg(t, '|' ORDER BY v), '') FROM (SELECT v, {shown('v', k)} AS t FROM "
        f"(SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL) ORDER BY v LIMIT 3)) AS samples FROM {source}"
        for c, k in kinds.items()
    ]


@query("column_statistics", union(statistics_sql("h", HOLED), f"WITH {HOLED_SQL}"))
def column_statistics(spark, d):
    return rounded(P.column_statistics(spread(holed(spark, d), "l_orderkey", "l_linenumber")), 1)


@query("null_profile", f"WITH {HOLED_SQL} SELECT * FROM (" + union([
    f"SELECT '{c}' AS column_name, {nulls(c)} AS missing FROM h" for c in HOLED]) + ") WHERE missing > 0")
def null_profile(spark, d):
    return P.null_profile(holed(spark, d))


@query("describe_numeric", union([
    f"SELECT '{c}' AS column_name, count({c}) AS count, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}, 0.5)', 4)} AS median, "
    f"{r(f'quantile_cont({c}, 0.75)', 4)} AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in NUMERIC]))
def describe_numeric(spark, d):
    out = rounded(P.describe_numeric(table(spark, d, "lineitem")), 4)
    return out.select("column_name", "count", "mean", "std", "min", "q25", "median", "q75", "max")


@query("cardinality_categorical", union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM part" for c, k in PART.items() if k == "str"]))
def cardinality_categorical(spark, d):
    return P.cardinality_categorical(table(spark, d, "part"))


@query("profile_samples_dups", f"""WITH {HOLED_SQL}, dup AS (SELECT l_returnflag, l_linestatus, l_taxed, count(*) AS copies FROM h GROUP BY ALL)
    SELECT 'duplicate' AS part, coalesce(l_returnflag, '-') || '/' || coalesce(l_linestatus, '-') || '/' || coalesce(CAST(l_taxed AS VARCHAR), '-') AS item, copies AS n FROM
        (SELECT * FROM dup WHERE copies > 1 ORDER BY copies DESC, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_taxed NULLS FIRST LIMIT 5)
    UNION ALL SELECT 'pattern', {' || '.join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in HOLED)}, count(*) FROM h GROUP BY 2""")
def profile_samples_dups(spark, d):
    h = holed(spark, d)
    three = ["l_returnflag", "l_linestatus", "l_taxed"]
    dup = P.duplicate_examples(h.select(*three), 5)
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in three])
    return dup.select(F.lit("duplicate").alias("part"), text.alias("item"), F.col("copies").alias("n")).unionByName(
        P.missing_patterns(h).select(F.lit("pattern").alias("part"), F.col("pattern").alias("item"), "n")
    )


EDGE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]


@query("profile_edge_rows", union([
    f"SELECT '{part}' AS part, row_number() OVER (ORDER BY {', '.join(f'{c} {way}' for c in EDGE)}) AS position, {', '.join(EDGE)} FROM h QUALIFY position <= 5"
    for part, way in (("head", "ASC NULLS FIRST"), ("tail", "DESC NULLS LAST"))], f"WITH {HOLED_SQL}"))
def profile_edge_rows(spark, d):
    return P.edge_rows(holed(spark, d).select(*EDGE), ["l_orderkey", "l_linenumber"], 5)


@query("value_counts", f"""SELECT o_orderpriority AS value, count(*) AS n, {r('count(*) * 100.0 / (SELECT count(*) FROM orders)')} AS pct
    FROM orders GROUP BY 1""")
def value_counts(spark, d):
    return rounded(Q.value_counts(table(spark, d, "orders"), "o_orderpriority"))


@query("class_balance", f"""SELECT count(*) AS n_classes, {r('max(n) * 100.0 / sum(n)')} AS max_pct, {r('min(n) * 100.0 / sum(n)')} AS min_pct,
    {r('max(n) / min(n)')} AS balance_ratio FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)""")
def class_balance(spark, d):
    return rounded(Q.class_balance(table(spark, d, "labels"), "quality"))


DUP = "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@query("duplicate_rows", f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows
    FROM (SELECT {DUP}, count(*) AS n FROM lineitem GROUP BY ALL)""")
def duplicate_rows(spark, d):
    return P.duplicate_rows(table(spark, d, "lineitem").select(*DUP.split(", ")))


@query("numeric_range_stats", union([
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {r(f'avg({c})', 4)} AS mean, "
    f"{r(f'coalesce(stddev_samp({c}), 0)', 4)} AS std FROM lineitem" for c in NUMERIC]))
def numeric_range_stats(spark, d):
    return rounded(P.numeric_range_stats(table(spark, d, "lineitem")), 4)


@query("quartiles", union([
    f"SELECT '{c}' AS column_name, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r(f'quantile_cont({c}, 0.75)')} AS q75 FROM h" for c in ("l_quantity", "l_extendedprice", "l_discount")], f"WITH {HOLED_SQL}"))
def quartiles(spark, d):
    return rounded(P.quartiles(holed(spark, d), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("mode_value", union([
    f"SELECT '{c}' AS column_name, value, n FROM (SELECT {shown(c, k)} AS value, count(*) AS n FROM h WHERE {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)" for c, k in HOLED.items()], f"WITH {HOLED_SQL}"))
def mode_value(spark, d):
    h = holed(spark, d)
    top = Q.modes(Q.value_frequencies(h))
    return top.select("column_name", Q.value_text(h).alias("value"), "n")


HEAVY = {"l_partkey": "int", "l_quantity": "float", "l_shipdate": "datetime", "l_returnflag": "str"}


@query("top_values", union([
    f"SELECT '{c}' AS column_name, {shown(c, k)} AS value, count(*) AS n FROM lineitem GROUP BY {c} QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5"
    for c, k in HEAVY.items()]))
def top_values(spark, d):
    rows = table(spark, d, "lineitem").select(*HEAVY)
    best = heavy.heavy_values(Q.cells(rows).where(Q.is_value()), Q.CELL, 5, ["column_name"])
    return best.select("column_name", Q.value_text(rows).alias("value"), "n")


@query("mode_value_heavy", union([
    f"SELECT '{c}' AS column_name, value, n FROM (SELECT {shown(c, k)} AS value, count(*) AS n FROM h WHERE {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)" for c, k in HOLED.items()], f"WITH {HOLED_SQL}"))
def mode_value_heavy(spark, d):
    h = holed(spark, d)
    return heavy.column_modes(h).select("column_name", Q.value_text(h).alias("value"), "n")


OPTION_COLUMNS = ["p_brand", "p_type", "p_size"]


@query("most_common_option", union([
    f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM part) AS n_options, CAST({c} AS VARCHAR) AS default_option, n AS default_n "
    f"FROM (SELECT {c}, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, CAST({c} AS VARCHAR) LIMIT 1)" for c in OPTION_COLUMNS]))
def most_common_option(spark, d):
    return Q.most_common_option(table(spark, d, "part"), OPTION_COLUMNS)


@query("categorical_options", union([
    f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS option FROM part WHERE {c} IS NOT NULL" for c in OPTION_COLUMNS]))
def categorical_options(spark, d):
    return Q.options(table(spark, d, "part"), OPTION_COLUMNS).select("column_name", "option")


def correlation_sql(columns, target, source="lineitem"):
    return union([
        f"SELECT '{c}' AS column_name, corr({c}, {target}) AS r FROM {source}" for c in columns if c != target])


@query("target_correlation", f"""SELECT column_name, {r('r')} AS r, {r('abs(r)')} AS abs_r,
    CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, column_name) AS INTEGER) AS rank FROM ({correlation_sql(NUMERIC, 'l_extendedprice')})""")
def target_correlation(spark, d):
    return rounded(C.target_correlation(table(spark, d, "lineitem"), "l_extendedprice"))


PAIR_EXPRS = ["l_quantity", "l_discount", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net", "l_tax", "l_quantity * 2 + l_tax AS q2"]
PAIR_COLUMNS = ["l_quantity", "l_discount", "l_extendedprice", "net", "l_tax", "q2"]
PAIR_SQL = f"p AS (SELECT {', '.join(PAIR_EXPRS)} FROM lineitem)"


@query("correlated_pairs", f"WITH {PAIR_SQL} SELECT left_column, right_column, {r('abs_r')} AS abs_r FROM (" + union([
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, abs(corr({a}, {b})) AS abs_r FROM p"
    for i, a in enumerate(PAIR_COLUMNS) for b in PAIR_COLUMNS[i + 1:]]) + ") WHERE abs_r > 0.95")
def correlated_pairs(spark, d):
    return rounded(C.correlated_pairs(table(spark, d, "lineitem").selectExpr(*PAIR_EXPRS)))


@query("leakage_by_correlation", f"""WITH {PAIR_SQL}, c AS ({correlation_sql(PAIR_COLUMNS, 'net', 'p')})
    SELECT column_name, {r('abs(r)')} AS abs_r, 'correlation' AS reason FROM c WHERE abs(r) > 0.98
    UNION ALL SELECT column_name, {r('abs(r)')}, 'name' FROM c WHERE column_name = 'l_extendedprice'""")
def leakage_by_correlation(spark, d):
    return rounded(C.leakage(table(spark, d, "lineitem").selectExpr(*PAIR_EXPRS), "net", 0.98))


@query("group_target_stats", f"""SELECT o_orderpriority AS value, count(o_totalprice) AS n, {r('avg(o_totalprice)', 4)} AS mean,
    {r('stddev_samp(o_totalprice)', 4)} AS std FROM orders GROUP BY 1""")
def group_target_stats(spark, d):
    return rounded(C.group_target_stats(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4)


GROUPS = "g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1)"


@query("eta_squared", f"""WITH {GROUPS}, t AS (SELECT avg(o_totalprice) AS gm FROM orders) SELECT count(*) AS n_groups,
    {r('sum(n * (m - gm) * (m - gm)) / (sum(n * (m - gm) * (m - gm)) + sum(n * v))')} AS eta_squared FROM g, t""")
def eta_squared(spark, d):
    return rounded(C.eta_squared(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@query("group_spread_pct", f"""WITH {GROUPS} SELECT {r('(max(m) - min(m)) / (SELECT avg(o_totalprice) FROM orders) * 100')} AS spread_pct,
    {r('(SELECT avg(o_totalprice) FROM orders)', 4)} AS overall_mean FROM g""")
def group_spread_pct(spark, d):
    return rounded(C.group_spread(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), overall_mean=4)


def variation_sql(source, kinds):
    return union([
        f"SELECT '{c}' AS column_name, coalesce(stddev_samp({c}) / nullif(abs(avg({c})), 0), stddev_samp({c})) AS score FROM {source}"
        if k in ("int", "float") else
        f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) + (CASE WHEN {nulls(c)} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM {source}"
        for c, k in kinds.items()])


@query("coefficient_of_variation", f"WITH {HOLED_SQL} SELECT column_name, {r('score')} AS score FROM ({variation_sql('h', HOLED)})")
def coefficient_of_variation(spark, d):
    return rounded(P.coefficient_of_variation(holed(spark, d)))


@query("histogram_equal_width", f"""WITH s AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx, avg(o_totalprice) AS av, stddev_pop(o_totalprice) AS sd FROM orders),
    c AS (SELECT CAST(least(floor((o_totalprice - mn) / (mx - mn) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM orders, s GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, {r('mn + b.bin * (mx - mn) / 30', 4)} AS bin_start, {r('mn + (b.bin + 1) * (mx - mn) / 30', 4)} AS bin_end,
    coalesce(n, 0) AS n, {r('av', 4)} AS mean, {r('sd', 4)} AS std, mn AS min, mx AS max FROM (SELECT unnest(range(30)) AS bin) b LEFT JOIN c ON b.bin = c.bin, s""")
def histogram_equal_width(spark, d):
    return rounded(P.histogram(table(spark, d, "orders"), "o_totalprice"), 4)


# -- ordered operators, top-k, set operations --------------------------------

FFILL_EXPRS = ["event_id", "ts", "CASE WHEN event_id % 5 <> 2 OR event_id < 30 THEN NULL ELSE ts END AS seen_at"]


@query("ffill_bfill_datetime", f"""WITH e AS (SELECT {', '.join(FFILL_EXPRS)} FROM events)
    SELECT event_id, strftime(coalesce(last_value(seen_at IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(seen_at IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), TIMESTAMP '1900-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS seen_at FROM e""")
def ffill_bfill_datetime(spark, d):
    e = table(spark, d, "events").selectExpr(*FFILL_EXPRS)
    out = cleaning.fill_from_neighbours(e, "seen_at", ["ts", "event_id"])
    return out.select("event_id", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("seen_at"))


SCORES_SQL = f"s AS (SELECT column_name, abs(r) AS score FROM ({correlation_sql(NUMERIC, 'l_extendedprice')}))"


def correlation_scores(spark, d):
    return C.target_correlation(table(spark, d, "lineitem"), "l_extendedprice").select("column_name", F.col("abs_r").alias("score"))


@query("importance_rank", f"""WITH {SCORES_SQL} SELECT column_name, {r('score')} AS score,
    CAST(row_number() OVER (ORDER BY score DESC, column_name) AS INTEGER) AS rank FROM s""")
def importance_rank(spark, d):
    return rounded(I.importance_rank(correlation_scores(spark, d)))


@query("top_k_features", f"WITH {SCORES_SQL} SELECT column_name, {r('score')} AS score FROM (SELECT * FROM s ORDER BY score DESC, column_name LIMIT 5)")
def top_k_features(spark, d):
    return rounded(I.top_features(correlation_scores(spark, d), 5))


@query("drop_duplicates", f"SELECT DISTINCT {DUP} FROM lineitem")
def drop_duplicates(spark, d):
    return cleaning.drop_duplicates(table(spark, d, "lineitem").select(*DUP.split(", ")))


@query("importance_normalise_tiers", f"""WITH {SCORES_SQL}, n AS (SELECT column_name, score, score / (SELECT max(score) FROM s) AS importance FROM s)
    SELECT column_name, {r('score')} AS score, {r('importance')} AS importance,
    CASE WHEN importance >= 0.7 THEN 'high' WHEN importance >= 0.3 THEN 'medium' ELSE 'low' END AS tier,
    CAST(row_number() OVER (ORDER BY importance DESC, column_name) AS INTEGER) AS rank FROM n""")
def importance_normalise_tiers(spark, d):
    return rounded(I.tiers(correlation_scores(spark, d)))


