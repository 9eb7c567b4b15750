"""Models shared by several queries, and the SQL that gives their predictions exactly.

The linear model has two features, so its least-squares solution is a formula
over covariances.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.sql import DataFrame, functions as F

from ...operators import training
from .base import table

LINEAR_FEATURES = ["l_extendedprice", "l_discount"]
CHARGE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"

LINEAR_SQL = f"""WITH li AS (SELECT *, {CHARGE} AS charge FROM lineitem),
    m AS (SELECT avg(charge) AS my, avg(l_extendedprice) AS m1, avg(l_discount) AS m2,
        var_pop(l_extendedprice) AS v1, var_pop(l_discount) AS v2, covar_pop(l_extendedprice, l_discount) AS v12,
        covar_pop(charge, l_extendedprice) AS c1, covar_pop(charge, l_discount) AS c2 FROM li),
    w AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM m),
    scored AS (SELECT li.*, w.*, my + b1 * (l_extendedprice - m1) + b2 * (l_discount - m2) AS prediction FROM li, w)"""


def linear_inputs(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")


def linear_model(spark, d) -> PipelineModel:
    data = linear_inputs(spark, d).withColumn("charge", F.expr(CHARGE)).select(*LINEAR_FEATURES, "charge")
    return training.finalize(R.LinearRegression(solver="normal"), data, "charge")


BAYES_FEATURES = ["l_quantity", "l_price_k"]
BAYES_LABELS = ["A", "N", "R"]
BAYES_EXPRS = [
    "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice / 1000 AS l_price_k",
    "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label",
]


def bayes_inputs(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*BAYES_EXPRS)


def bayes_model(spark, d) -> PipelineModel:
    data = bayes_inputs(spark, d).select(*BAYES_FEATURES, "label")
    return training.finalize(C.NaiveBayes(modelType="gaussian"), data, "label")


def _log_density(x: str, m: str, v: str) -> str:
    return f"(-0.5 * ln(2 * pi() * ({v} + e)) - ({x} - {m}) * ({x} - {m}) / (2 * ({v} + e)))"


def _log_joint(k: int) -> str:
    picks = {a: f"max(CASE WHEN label = {k} THEN {a} END)" for a in ("n", "m1", "m2", "v1", "v2")}
    return ", ".join(f"{e} AS {a}_{k}" for a, e in picks.items())


_SCORES = ", ".join(
    f"ln(n_{k} / total) + {_log_density('l_quantity', f'm1_{k}', f'v1_{k}')} + {_log_density('l_price_k', f'm2_{k}', f'v2_{k}')} AS s_{k}"
    for k in range(3)
)
BAYES_SQL = f"""WITH li AS (SELECT {', '.join(BAYES_EXPRS)} FROM lineitem),
    t AS (SELECT count(*) AS total, 1e-9 * greatest(var_pop(l_quantity), var_pop(l_price_k)) AS e FROM li),
    g AS (SELECT label, count(*) AS n, avg(l_quantity) AS m1, var_pop(l_quantity) AS v1, avg(l_price_k) AS m2, var_pop(l_price_k) AS v2 FROM li GROUP BY label),
    q AS (SELECT {', '.join(_log_joint(k) for k in range(3))} FROM g),
    s AS (SELECT li.*, {_SCORES} FROM li, t, q),
    x AS (SELECT *, exp(s_0 - greatest(s_0, s_1, s_2)) AS e_0, exp(s_1 - greatest(s_0, s_1, s_2)) AS e_1, exp(s_2 - greatest(s_0, s_1, s_2)) AS e_2 FROM s),
    scored AS (SELECT *, e_0 / (e_0 + e_1 + e_2) AS p_0, e_1 / (e_0 + e_1 + e_2) AS p_1, e_2 / (e_0 + e_1 + e_2) AS p_2 FROM x)"""
