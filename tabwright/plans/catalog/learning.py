"""Training, explanation and model metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from ...functions.sizing import parted, spread
from ...operators import explaining as X, metrics as M, training as T
from ...operators.tree_attribution import tree_attribution
from .base import LINEITEM, query, r, rounded, table
from .models import (
    BAYES_EXPRS, BAYES_FEATURES, BAYES_SQL, CHARGE, LINEAR_FEATURES, LINEAR_SQL, bayes_inputs, bayes_model, linear_inputs, linear_model,
)


@query("training_input_checks", """WITH s AS (SELECT count(*) AS n, count(quality) AS p, count(DISTINCT quality) AS u FROM labels)
    SELECT 'enough_rows' AS "check", n >= 30 AS passed, CAST(n AS DOUBLE) AS observed FROM s UNION ALL SELECT 'enough_columns', true, CAST(3 AS DOUBLE) FROM s
    UNION ALL SELECT 'known_task', true, NULL FROM s UNION ALL SELECT 'target_exists', true, NULL FROM s
    UNION ALL SELECT 'target_not_all_null', p > 0, CAST(p AS DOUBLE) FROM s UNION ALL SELECT 'target_mostly_present', 1 - p / n <= 0.5, CAST(1 - p / n AS DOUBLE) FROM s
    UNION ALL SELECT 'target_varies', u >= 2, NULL FROM s""")
def training_input_checks(spark, d):
    return T.training_input_checks(table(spark, d, "labels"), "quality", "classification")


@query("train_test_split", """SELECT CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) < 'cccc' THEN 'train' ELSE 'test' END AS part,
    o_orderkey, o_totalprice FROM orders""")
def train_test_split(spark, d):
    train, test = T.train_test_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))


def quality_rows(spark, d):
    """Labelled documents with numeric features; every labelled document is used."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        *[(F.col("lang") == x).cast("int").alias(f"lang_{x}") for x in ("de", "en", "fr")],
        F.length(F.regexp_replace("text", r"[^\p{P}]", "")).cast("double").alias("punctuation"),
    )
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


FOLDS = 5


def fold_sql(*keys: str) -> str:
    head = "substr(md5('fold-' || " + " || '-' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "), 1, 4)"
    return " + ".join(f"CAST({head} >= '{-(-65536 * i // FOLDS):04x}' AS INT)" for i in range(1, FOLDS))


def charge_rows(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", *LINEAR_FEATURES, F.expr(CHARGE).alias("charge"))


LINEAR_FAMILY = {"linear": (0, 0), "glm": (0, 0), "ridge": (0.1, 0), "lasso": (0.1, 1), "elastic_net": (0.1, 0.5)}


def board_sql() -> str:
    """Least squares with penalties over three features for every fold, by Cramer's rule; metrics averaged over the folds.

    With a penalty on absolute values the signs are those without one (they are, as the penalty is small).
    """
    x = ["l_quantity", *LINEAR_FEATURES]
    names = [*x, "charge"]
    moments = [f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(names)]
    moments += [f"corr({names[i]}, {names[j]}) AS c{i}{j}" for i in range(4) for j in range(i + 1, 4)]

    def det(rows):
        (a, b, c), (d, e, f), (g, h, i) = rows
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    def solved(diagonal, right):
        a = [[diagonal if i == j else f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
        return [f"{det([[right[i] if j == k else a[i][j] for j in range(3)] for i in range(3)])} / {det(a)}" for k in range(3)]

    plain = ", ".join(f"sign({b}) AS g{i}" for i, b in enumerate(solved("1.0", ["c03", "c13", "c23"])))
    betas = ", ".join(f"{b} AS b{i}" for i, b in enumerate(solved("(1 + l2)", [f"(c{i}3 - l1 * g{i})" for i in range(3)])))
    models = ", ".join(f"('{m}', CAST({p} AS DOUBLE), CAST({e} AS DOUBLE))" for m, (p, e) in LINEAR_FAMILY.items())
    return f"""li AS (SELECT *, {CHARGE} AS charge, {fold_sql('l_orderkey', 'l_linenumber')} AS fold FROM lineitem),
    part AS (SELECT k, {', '.join(moments)} FROM li, unnest(range({FOLDS})) AS u(k) WHERE fold <> k GROUP BY k),
    signed AS (SELECT *, {plain} FROM part),
    model AS (SELECT * FROM (VALUES {models}) AS v(model, penalty, share)),
    strength AS (SELECT *, penalty * share / s3 AS l1, penalty * (1 - share) / s3 AS l2 FROM signed, model),
    beta AS (SELECT *, {betas} FROM strength),
    scored AS (SELECT model, k, charge, m3 + {' + '.join(f'b{i} * s3 / s{i} * ({c} - m{i})' for i, c in enumerate(x))} AS p FROM li JOIN beta ON fold = k),
    fold_metrics AS (SELECT model, k, 1 - avg((charge - p) ^ 2) / var_pop(charge) AS r2, sqrt(avg((charge - p) ^ 2)) AS rmse,
        avg(abs(charge - p)) AS mae, avg(abs((charge - p) / nullif(charge, 0))) AS mape FROM scored GROUP BY model, k),
    board AS (SELECT model, CAST(count(*) AS INTEGER) AS folds_done, CAST(NULL AS VARCHAR) AS error, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae, avg(mape) AS mape FROM fold_metrics GROUP BY model)"""


BOARD_COLUMNS = f"model, folds_done, error, {r('r2')} AS r2, {r('rmse', 4)} AS rmse, {r('mae', 4)} AS mae, {r('mape')} AS mape"
BY_R2 = "CAST(row_number() OVER (ORDER BY round(r2, 9) DESC, model) AS INTEGER) AS rank"


def charge_board(spark, d):
    models = {k: v for k, v in T.candidates("regression").items() if k in LINEAR_FAMILY}
    return T.compare_models(charge_rows(spark, d), "charge", "regression", ["l_orderkey", "l_linenumber"], models=models)


@query("compare_models", f"WITH {board_sql()} SELECT * FROM (SELECT {BOARD_COLUMNS}, {BY_R2} FROM board) WHERE rank <= 3")
def compare_models(spark, d):
    """The linear family; the three best."""
    return rounded(charge_board(spark, d).orderBy("rank").limit(3), rmse=4, mae=4)


@query("compare_all_models")
def compare_all_models(spark, d):
    """Every regression candidate: the linear family from one scan, tree models fitted fold by fold."""
    return rounded(T.compare_models(charge_rows(spark, d), "charge", "regression", ["l_orderkey", "l_linenumber"]))


def class_board_sql() -> str:
    """Naive Bayes and both discriminants over two features and three classes, for every fold."""
    cells = [f"{f}({c}) AS {a}" for f, c, a in (
        ("avg", "l_quantity", "m1"), ("avg", "l_price_k", "m2"), ("var_pop", "l_quantity", "v1"), ("var_pop", "l_price_k", "v2"))]
    quadratic = "(({x1}) * ({x1}) * {b} - 2 * ({x1}) * ({x2}) * {c} + ({x2}) * ({x2}) * {a}) / ({a} * {b} - {c} * {c})".format
    near = {"x1": "l_quantity - m1", "x2": "l_price_k - m2"}
    own = quadratic(a="(v1 * n / (n - 1))", b="(v2 * n / (n - 1))", c="(v12 * n / (n - 1))", **near)
    pooled = quadratic(a="p1", b="p2", c="p12", **near)
    return f"""li AS MATERIALIZED (SELECT {', '.join(BAYES_EXPRS)}, {fold_sql('l_orderkey', 'l_linenumber')} AS fold, row_number() OVER () AS id FROM lineitem),
    kept AS (SELECT li.*, k FROM li, unnest(range({FOLDS})) AS u(k) WHERE fold <> k),
    whole AS (SELECT k, count(*) AS total, 1e-9 * greatest(var_pop(l_quantity), var_pop(l_price_k)) AS e FROM kept GROUP BY k),
    g AS (SELECT k, label, count(*) AS n, {', '.join(cells)}, covar_pop(l_quantity, l_price_k) AS v12 FROM kept GROUP BY k, label),
    pool AS (SELECT k, sum(n * v1) / (sum(n) - count(*)) AS p1, sum(n * v2) / (sum(n) - count(*)) AS p2, sum(n * v12) / (sum(n) - count(*)) AS p12 FROM g GROUP BY k),
    s AS (SELECT li.id, li.label AS y, k, g.label AS class, ln(n / total) AS prior,
        -0.5 * (ln(v1 + e) + ln(v2 + e)) - (l_quantity - m1) ^ 2 / (2 * (v1 + e)) - (l_price_k - m2) ^ 2 / (2 * (v2 + e)) AS naive_bayes,
        -0.5 * ({pooled}) AS linear_discriminant, -0.5 * ln((v1 * v2 - v12 * v12) * (n / (n - 1)) ^ 2) - 0.5 * ({own}) AS quadratic_discriminant
        FROM li JOIN g ON li.fold = g.k JOIN whole USING (k) JOIN pool USING (k)),
    t AS (UNPIVOT s ON naive_bayes, linear_discriminant, quadratic_discriminant INTO NAME model VALUE score),
    top AS (SELECT *, prior + score - max(prior + score) OVER w AS gap FROM t WINDOW w AS (PARTITION BY model, id)),
    p AS (SELECT *, exp(gap) / sum(exp(gap)) OVER w AS p, row_number() OVER (PARTITION BY model, id ORDER BY gap DESC, class) AS place FROM top WINDOW w AS (PARTITION BY model, id)),
    cell AS (SELECT model, k, y, class, count(*) AS n FROM p WHERE place = 1 GROUP BY ALL),
    support AS (SELECT model, k, y AS class, sum(n) AS support, sum(n) FILTER (y = class) AS hits FROM cell GROUP BY model, k, y),
    guessed AS (SELECT model, k, class, sum(n) AS guessed FROM cell GROUP BY ALL),
    ranked AS (SELECT model, k, class, y = class AS own, rank() OVER (PARTITION BY model, k, class ORDER BY p) + (count(*) OVER (PARTITION BY model, k, class, p) - 1) / 2.0 AS rk FROM p),
    area AS (SELECT model, k, class, (sum(rk) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0) / (CAST(count(*) FILTER (own) AS DOUBLE) * count(*) FILTER (NOT own)) AS auc
        FROM ranked GROUP BY ALL),
    each_class AS (SELECT *, coalesce(hits, 0) AS h FROM support LEFT JOIN guessed USING (model, k, class) JOIN area USING (model, k, class)),
    fold_metrics AS (SELECT model, k, sum(h) / sum(support) AS accuracy, sum(auc * support) / sum(support) AS auc, sum(support * 2 * h / (support + coalesce(guessed, 0))) / sum(support) AS f1,
        sum(support * coalesce(h / nullif(guessed, 0), 0)) / sum(support) AS precision, sum(h) / sum(support) AS recall FROM each_class GROUP BY model, k),
    board AS (SELECT model, CAST(count(*) AS INTEGER) AS folds_done, CAST(NULL AS VARCHAR) AS error, avg(accuracy) AS accuracy, avg(auc) AS auc, avg(f1) AS f1, avg(precision) AS precision, avg(recall) AS recall
        FROM fold_metrics GROUP BY model)"""


CLASS_MODELS = ("naive_bayes", "linear_discriminant", "quadratic_discriminant")


@query("leaderboard", f"""WITH {class_board_sql()} SELECT model, folds_done, error, {', '.join(f'{r(c)} AS {c}' for c in ('accuracy', 'auc', 'f1', 'precision', 'recall'))},
    CAST(row_number() OVER (ORDER BY round(accuracy, 9) DESC, model) AS INTEGER) AS rank FROM board""")
def leaderboard(spark, d):
    """The classifiers with a closed form, on all rows of lineitem."""
    models = {k: v for k, v in T.candidates("classification", 3, 2).items() if k in CLASS_MODELS}
    return rounded(T.compare_models(bayes_inputs(spark, d), "label", "classification", ["l_orderkey", "l_linenumber"], models=models))


@query("leaderboard_all_models")
def leaderboard_all_models(spark, d):
    """Every two-class candidate on all labelled documents."""
    return rounded(T.compare_models(quality_rows(spark, d), "quality", "classification", ["doc_id"]))


@query("leaderboard_rank", f"WITH {board_sql()} SELECT model, CAST(row_number() OVER (ORDER BY round(rmse, 9), model) AS INTEGER) AS rank, {r('rmse', 4)} AS rmse FROM board")
def leaderboard_rank(spark, d):
    board = charge_board(spark, d)
    return rounded(T.leaderboard(board.drop("rank"), "regression", by="rmse").select("model", "rank", "rmse"), rmse=4)


@query("top_models_summary", f"WITH {board_sql()} SELECT {BOARD_COLUMNS}, {BY_R2} FROM board")
def top_models_summary(spark, d):
    return rounded(T.top_models(charge_board(spark, d), 5), rmse=4, mae=4)


DISCRIMINANT_SQL = f"""WITH li AS MATERIALIZED (SELECT {', '.join(BAYES_EXPRS)}, row_number() OVER () AS id FROM lineitem), total AS (SELECT count(*) AS total FROM li),
    g AS (SELECT label, count(*) AS n, avg(l_quantity) AS m1, avg(l_price_k) AS m2, var_samp(l_quantity) AS a, var_samp(l_price_k) AS b, covar_samp(l_quantity, l_price_k) AS c FROM li GROUP BY label),
    pool AS (SELECT sum((n - 1) * a) / (sum(n) - count(*)) AS pa, sum((n - 1) * b) / (sum(n) - count(*)) AS pb, sum((n - 1) * c) / (sum(n) - count(*)) AS pc FROM g),
    s AS (SELECT id, l_orderkey, l_linenumber, g.label AS class, ln(n / total) - 0.5 * ((l_quantity - m1) ^ 2 * pb - 2 * (l_quantity - m1) * (l_price_k - m2) * pc + (l_price_k - m2) ^ 2 * pa) / (pa * pb - pc * pc) AS s1,
        ln(n / total) - 0.5 * ln(a * b - c * c) - 0.5 * ((l_quantity - m1) ^ 2 * b - 2 * (l_quantity - m1) * (l_price_k - m2) * c + (l_price_k - m2) ^ 2 * a) / (a * b - c * c) AS s2 FROM li, g, total, pool),
    q AS (SELECT *, exp(s1 - max(s1) OVER w) AS e1, exp(s2 - max(s2) OVER w) AS e2 FROM s WINDOW w AS (PARTITION BY id))"""


@query("discriminant_predictions", f"""{DISCRIMINANT_SQL}, p AS (SELECT *, e1 / sum(e1) OVER w AS p1, e2 / sum(e2) OVER w AS p2 FROM q WINDOW w AS (PARTITION BY id))
    SELECT l_orderkey, l_linenumber, {', '.join(f"{r(f'max(CASE WHEN class = {k} THEN p{j} END)', 5)} AS {n}_{k}" for j, n in ((1, 'linear'), (2, 'quadratic')) for k in range(3))} FROM p GROUP BY id, l_orderkey, l_linenumber""")
def discriminant_predictions(spark, d):
    """Class probabilities by the linear and the quadratic discriminant, fitted on all rows."""
    from pyspark.ml.functions import vector_to_array

    rows = spread(bayes_inputs(spark, d), "l_orderkey", "l_linenumber")
    out = rows
    for kind in ("linear", "quadratic"):
        model = T.finalize(T.candidates("classification", 3, 2)[f"{kind}_discriminant"], rows.select(*BAYES_FEATURES, "label"), "label")
        p = vector_to_array(F.col("probability"))
        out = model.transform(out.select("*")).select(*out.columns, *[p[k].alias(f"{kind}_{k}") for k in range(3)])
    return rounded(out.drop(*BAYES_FEATURES, "label"), 5)


@query("fallback_model", f"""{LINEAR_SQL} SELECT 'fallback' AS model, {r('my - b1 * m1 - b2 * m2', 2)} AS intercept, {r('b1')} AS w_price, {r('b2', 2)} AS w_discount FROM w""")
def fallback_model(spark, d):
    """With no comparable model the plain linear one is trained."""
    empty = spark.createDataFrame([], "model string, rank int")
    name, model = T.winner(empty, "regression")
    fitted = T.finalize(model, charge_rows(spark, d).select(*LINEAR_FEATURES, "charge"), "charge").stages[-1]
    row = (name, float(fitted.intercept), *[float(w) for w in fitted.coefficients])
    return rounded(spark.createDataFrame([row], "model string, intercept double, w_price double, w_discount double"), 2, w_price=6)


@query("finalize_model", f"""{LINEAR_SQL} SELECT count(*) AS n, {r('avg(prediction)', 2)} AS mean_prediction, {r('1 - avg((charge - prediction) ^ 2) / var_pop(charge)')} AS r2 FROM scored""")
def finalize_model(spark, d):
    data = charge_rows(spark, d)
    model = T.finalize(R.LinearRegression(solver="normal"), data.select(*LINEAR_FEATURES, "charge"), "charge")
    scored = model.transform(data)
    r2 = 1 - F.avg((F.col("charge") - F.col("prediction")) ** 2) / F.var_pop("charge")
    return rounded(scored.agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_prediction"), r2.alias("r2")), mean_prediction=2)


@query("class_labels", "SELECT DISTINCT o_orderpriority AS label FROM orders")
def class_labels(spark, d):
    return T.class_labels(table(spark, d, "orders"), "o_orderpriority")


@query("samples_per_feature", f"SELECT count(*) AS n_rows, {len(LINEITEM) - 1} AS n_features, {r(f'count(*) / {len(LINEITEM) - 1}')} AS ratio, count(*) / {len(LINEITEM) - 1} >= 10 AS enough FROM lineitem")
def samples_per_feature(spark, d):
    return rounded(T.samples_per_feature(table(spark, d, "lineitem"), "l_extendedprice"))


# A fixed rule stands in for a classifier, so that its metrics have exact answers.
RULE = "CAST(l_quantity > 20 AS INT) AS prediction, l_quantity * (1 - l_discount) AS score, CAST(l_extendedprice > 45000 AS INT) AS label"


@query("classification_metrics", f"""WITH p AS (SELECT {RULE} FROM lineitem),
    c AS (SELECT count(*) AS n, avg(CAST(label = prediction AS DOUBLE)) AS a, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
        count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM p),
    k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM p),
    u AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
        / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc FROM k)
    SELECT n, {r('a')} AS accuracy, {r('tp / (tp + fp)')} AS precision, {r('tp / (tp + fn)')} AS recall, {r('2 * tp / (2 * tp + fp + fn)')} AS f1, {r('auc')} AS auc FROM c, u""")
def classification_metrics(spark, d):
    p = table(spark, d, "lineitem").selectExpr(RULE.split(", ")[0], *RULE.split(", ")[1:])
    area = M.auc(p, "label", "score").first()["auc"]
    return rounded(M.classification_metrics(p, "label", "prediction").withColumn("auc", F.lit(area)))


@query("regression_metrics", f"""{LINEAR_SQL} SELECT count(*) AS n, {r('1 - avg((charge - prediction) ^ 2) / var_pop(charge)')} AS r2,
    {r('sqrt(avg((charge - prediction) ^ 2))', 4)} AS rmse, {r('avg(abs(charge - prediction))', 4)} AS mae, {r('avg(abs((charge - prediction) / charge))')} AS mape FROM scored""")
def regression_metrics(spark, d):
    scored = linear_model(spark, d).transform(linear_inputs(spark, d)).withColumn("charge", F.expr(CHARGE))
    return rounded(M.regression_metrics(scored, "charge", "prediction"), rmse=4, mae=4)


# -- explanation -------------------------------------------------------------


@query("explain_input_checks", """SELECT 'enough_rows' AS "check", count(*) >= 2 AS passed, CAST(count(*) AS DOUBLE) AS observed FROM lineitem
    UNION ALL SELECT 'enough_features', true, CAST(10 AS DOUBLE) UNION ALL SELECT 'known_task', true, NULL UNION ALL SELECT 'all_numeric', false, CAST(3 AS DOUBLE)""")
def explain_input_checks(spark, d):
    return X.explain_input_checks(table(spark, d, "lineitem"), "l_extendedprice", "regression")


@query("explain_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 500")
def explain_sample(spark, d):
    return X.explain_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


MARGIN = "(l_quantity - 25) / 10"


@query("probability_adapter", f"""SELECT l_orderkey, l_linenumber, {r(f'1 / (1 + exp(-{MARGIN}))')} AS p_binary,
    {r(f'exp(l_discount) / (exp(l_discount) + exp(l_tax) + exp(0))')} AS p_multi, {r('CASE WHEN l_linenumber % 3 = 1 THEN 0.9 ELSE 0.05 END')} AS p_hard FROM lineitem""")
def probability_adapter(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(li.select(
        "l_orderkey", "l_linenumber",
        X.class_probabilities(F.expr(MARGIN))[1].alias("p_binary"),
        X.class_probabilities(F.array("l_discount", "l_tax", F.lit(0.0)), 3)[0].alias("p_multi"),
        X.hard_probabilities(F.col("l_linenumber") % 3, 3)[1].alias("p_hard"),
    ))


def linear_weights(model: PipelineModel) -> dict[str, float]:
    return dict(zip(LINEAR_FEATURES, map(float, model.stages[-1].coefficients)))


PHI_SQL = f"{LINEAR_SQL}, phi AS (SELECT l_orderkey, l_linenumber, 'l_extendedprice' AS feature, b1 * (l_extendedprice - m1) AS phi FROM scored UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', b2 * (l_discount - m2) FROM scored)"


@query("shap_values", f"{PHI_SQL} SELECT l_orderkey, l_linenumber, feature, {r('phi', 2)} AS phi FROM phi")
def shap_values(spark, d):
    weights = linear_weights(linear_model(spark, d))
    return rounded(X.linear_attribution(linear_inputs(spark, d), ["l_orderkey", "l_linenumber"], weights), 2)


FLAGS = "l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INT) AS big, CAST(l_discount > 0.05 AS INT) AS cheap, CAST(l_tax > 0.04 AS INT) AS taxed"
WORTH = "100.0 * big + 20.0 * cheap + 5.0 * taxed + 7.0 * big * cheap * taxed"


def subsets_sql() -> str:
    """Shapley values of a tree that asks big, then cheap, then taxed: the sum over all subsets of known features.

    The mean of a leaf is known; a feature outside the subset goes each way by the node's share of rows.
    """
    names = ("big", "cheap", "taxed")
    shares = ("l.n_a / l.n", "l.n_ab / l.n_a", "l.n_abc / l.n_ab")
    ways = " * ".join(f"CASE WHEN s & {1 << i} > 0 THEN CAST(x.{c} = l.{c} AS DOUBLE) ELSE {share} END" for i, (c, share) in enumerate(zip(names, shares)))
    parts = ", ".join(
        f"sum(v * CASE WHEN s & {1 << i} > 0 THEN 1 ELSE -1 END * w[1 + bit_count(s) - CAST(s & {1 << i} > 0 AS INT)]) AS phi_{c}" for i, c in enumerate(names))
    return f"""li AS (SELECT {FLAGS} FROM lineitem),
    cell AS (SELECT big, cheap, taxed, count(*) AS n_abc, avg({WORTH}) AS value FROM li GROUP BY ALL),
    l AS (SELECT *, sum(n_abc) OVER () AS n, sum(n_abc) OVER (PARTITION BY big) AS n_a, sum(n_abc) OVER (PARTITION BY big, cheap) AS n_ab FROM cell),
    v AS (SELECT x.big, x.cheap, x.taxed, s, sum(l.value * {ways}) AS v FROM cell x, l, unnest(range(8)) AS u(s) GROUP BY ALL),
    phi AS (SELECT big, cheap, taxed, {parts} FROM v, (SELECT [1.0 / 3, 1.0 / 6, 1.0 / 3] AS w) GROUP BY ALL)"""


@query("shap_values_tree", f"WITH {subsets_sql()} " + " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS feature, {r(f'phi_{c}')} AS phi FROM li JOIN phi USING (big, cheap, taxed)" for c in ("big", "cheap", "taxed")))
def shap_values_tree(spark, d):
    """Attribution of a fitted shallow tree for every row of lineitem."""
    rows = spread(table(spark, d, "lineitem"), "l_orderkey").selectExpr(*FLAGS.split(", ")).withColumn("worth", F.expr(WORTH))
    model = T.finalize(R.DecisionTreeRegressor(maxDepth=3, seed=123), rows, "worth", ["l_orderkey", "l_linenumber"])
    return rounded(tree_attribution(model, rows, ["l_orderkey", "l_linenumber"]))


KERNEL_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
KERNEL_BACKGROUND = (25.1234567, 30_011.3777, 0.0512345, 0.0412347, 3.1415926)
KERNEL_RULE = "{0} * {1} / 1000 * (1 - {2}) + 40 * {3} * {4} * {4} + CASE WHEN {0} > 20 THEN {1} / 500 ELSE 0 END"


def all_subsets_sql() -> str:
    """Shapley values of five features by all 32 subsets of every row."""
    mixed = [f"CASE WHEN s & {1 << i} > 0 THEN CAST({c} AS DOUBLE) ELSE {b} END" for i, (c, b) in enumerate(zip(KERNEL_FEATURES, KERNEL_BACKGROUND))]
    phi = ", ".join(
        f"sum(v * CASE WHEN s & {1 << i} > 0 THEN 1 ELSE -1 END * w[1 + bit_count(s) - CAST(s & {1 << i} > 0 AS INT)]) AS phi_{c}" for i, c in enumerate(KERNEL_FEATURES))
    return f"""li AS (SELECT DISTINCT l_orderkey, {', '.join(dict.fromkeys(KERNEL_FEATURES))} FROM lineitem),
    v AS (SELECT li.*, s, {KERNEL_RULE.format(*mixed)} AS v FROM li, unnest(range(32)) AS u(s)),
    phi AS (SELECT l_orderkey, {', '.join(KERNEL_FEATURES)}, {phi} FROM v, (SELECT [1.0 / 5, 1.0 / 20, 1.0 / 30, 1.0 / 20, 1.0 / 5] AS w) GROUP BY ALL)"""


@query("shap_values_kernel", f"WITH {all_subsets_sql()} " + " UNION ALL ".join(
    f"SELECT l_orderkey, {', '.join(KERNEL_FEATURES)}, '{c}' AS feature, {r(f'phi_{c}')} AS phi FROM phi" for c in KERNEL_FEATURES))
def shap_values_kernel(spark, d):
    """Kernel regression over all coalitions of five features, for a rule that no linear or tree model equals."""
    from pyspark.ml.feature import SQLTransformer

    li = table(spark, d, "lineitem")
    rows = li.select("l_orderkey", *[F.col(c).alias(f"k_{c}") for c in KERNEL_FEATURES], *KERNEL_FEATURES)
    rule = SQLTransformer(statement=f"SELECT *, {KERNEL_RULE.format(*KERNEL_FEATURES)} AS prediction FROM __THIS__")
    keys = ["l_orderkey", *[f"k_{c}" for c in KERNEL_FEATURES]]
    rows = parted(rows, keys, li.count()).distinct()
    phi = X.kernel_attribution(rule, rows, keys, KERNEL_FEATURES, background=[KERNEL_BACKGROUND], is_parted=True)
    return rounded(phi.toDF("l_orderkey", *KERNEL_FEATURES, "feature", "phi"))


@query("shap_values_forest")
def shap_values_forest(spark, d):
    """Attribution of a forest's class probability for all labelled documents."""
    rows = quality_rows(spark, d)
    model = T.finalize(C.RandomForestClassifier(seed=123), rows, "quality", ["doc_id"])
    return rounded(tree_attribution(model, rows, ["doc_id"], classes=2))


@query("shap_global_importance", f"{PHI_SQL} SELECT feature, {r('avg(abs(phi))', 4)} AS score FROM phi GROUP BY 1")
def shap_global_importance(spark, d):
    weights = linear_weights(linear_model(spark, d))
    phi = X.linear_attribution(linear_inputs(spark, d), ["l_orderkey", "l_linenumber"], weights)
    return rounded(X.global_importance(phi), 4)


@query("model_importance_fallback", f"{LINEAR_SQL} SELECT 'l_extendedprice' AS feature, {r('abs(b1)', 2)} AS score FROM w UNION ALL SELECT 'l_discount', {r('abs(b2)', 2)} FROM w")
def model_importance_fallback(spark, d):
    return rounded(X.model_importance(linear_model(spark, d), LINEAR_FEATURES), 2)


@query("predict_with_proba", f"""{BAYES_SQL} SELECT l_orderkey, l_linenumber, {r('p_0', 5)} AS p_a, {r('p_1', 5)} AS p_n, {r('p_2', 5)} AS p_r,
    {r('greatest(p_0, p_1, p_2)', 5)} AS confidence, CASE greatest(s_0, s_1, s_2) WHEN s_0 THEN 'A' WHEN s_1 THEN 'N' ELSE 'R' END AS predicted_class FROM scored""")
def predict_with_proba(spark, d):
    from ...operators import scoring
    from .models import BAYES_LABELS

    rows = spread(bayes_inputs(spark, d), "l_orderkey", "l_linenumber")
    out = scoring.with_probabilities(bayes_model(spark, d), rows, BAYES_LABELS)
    p = F.col("probabilities")
    return rounded(out.select(
        "l_orderkey", "l_linenumber", p["A"].alias("p_a"), p["N"].alias("p_n"), p["R"].alias("p_r"), "confidence", "predicted_class"), 5)


