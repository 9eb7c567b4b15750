"""Registry of the queries: a Spark function and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ...functions.columns import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINEITEM = {
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float",
    "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "str",
    "l_linestatus": "str", "l_shipdate": "datetime",
}
ORDERS = {
    "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float",
    "o_orderdate": "datetime", "o_orderpriority": "str",
}
CUSTOMER = {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "str"}
PART = {
    "p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "float",
}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = " ".join(sql.split("\n")) if "--" not in sql else sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Doubles rounded for comparison; `+ 0.0` turns a negative zero into zero."""
    return df.select(*[
        (F.round(col(f.name), per_column.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
        for f in df.schema.fields
    ])


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def union(parts: Sequence[str], before: str = "") -> str:
    return f"{before} " + " UNION ALL ".join(parts)


# The test tables hold almost no NULLs; these expressions make some, the same way on both sides.
HOLED_EXPRS = [
    "l_orderkey", "l_linenumber", "l_extendedprice",
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount",
    "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus",
    "CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_tax > 0.03 END AS l_taxed",
]
HOLED = {
    "l_orderkey": "int", "l_linenumber": "int", "l_extendedprice": "float", "l_quantity": "float", "l_discount": "float",
    "l_returnflag": "str", "l_linestatus": "str", "l_taxed": "bool",
}
HOLED_SQL = f"h AS (SELECT {', '.join(HOLED_EXPRS)} FROM lineitem)"


def holed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*HOLED_EXPRS)


def shown(c: str, kind: str) -> str:
    """SQL text of a cell, as `value_text` and `preview_text` print it."""
    if kind == "float":
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    if kind == "datetime":
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({c} AS VARCHAR)"


# A deterministic stand-in for a model's prediction, so that scoring operators have exact answers.
PSEUDO = "(l_extendedprice * 0.9 + l_quantity * 37.5 - l_discount * 1000.0)"
