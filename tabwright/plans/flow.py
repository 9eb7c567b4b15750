"""From raw table to trained, explained and scoring-ready model in one call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import kinds
from ..functions.sizing import new_path, pinned
from ..operators import cleaning, encoding, expectations, explaining, roles as R, training
from ..operators.tree_attribution import is_tree, tree_attribution
from ..sources import tables


class GateFailed(RuntimeError):
    """Too many expectations failed; nothing after validation was run."""


@dataclass
class Outcome:
    target: R.Target
    roles: dict[str, str]
    checks: DataFrame
    gate: DataFrame
    encoder: encoding.Encoder
    leaderboard: DataFrame
    winner: str
    model: PipelineModel
    importance: DataFrame


def run_table(
    df: DataFrame,
    keys: Sequence[str],
    target: str | None = None,
    confirmed: Mapping[str, str] | None = None,
    exclude_models: Sequence[str] = (),
    training_rows: int | None = None,
    explained_rows: int = fv.EXPLAIN_ROWS,
    background_rows: int = explaining.BACKGROUND_ROWS,
    permutations: int = 2,
) -> Outcome:
    """Roles, gate, clean-up, encoding, model comparison, refit and attribution.

    `keys` identify a row: they split folds, order fills and pick samples, and
    are never features.  `training_rows` bounds what models are compared on; the
    winner is fitted on all rows.  Linear winners are explained in closed form
    and tree models by their paths, both over all rows, others by `permutations` over `explained_rows` rows against
    `background_rows`; the importance table says how many rows it rests on.
    """
    goal = R.suggest_target(df, target)
    suggested = {c: r for c, r in R.suggest_roles(df).items() if c not in keys}
    merged = R.merge_roles(suggested, dict(confirmed or {}))
    chosen = {c: r for c, r, _ in merged}

    folded = kinds(df)
    suite = expectations.build_suite(df.columns, {c: (folded[c], r) for c, r in chosen.items()}, goal)
    checks = expectations.run_suite(df, suite)
    verdict = expectations.gate(checks)
    if not verdict.first()["can_proceed"]:
        raise GateFailed(str(verdict.first().asDict()))

    features = {c: r for c, r in chosen.items() if c != goal.name}
    # Written once: fits, folds and the final model all read the same clean rows.
    clean = pinned(cleaning.clean(df, chosen, goal, order=keys))
    encoder = encoding.fit_encoder(clean, features, goal)
    stage = encoder.as_stage(clean)
    ready = stage.transform(clean)
    board = training.compare_models(ready, goal.name, goal.task, keys, exclude=exclude_models, training_rows=training_rows)
    width = len(training.feature_columns(ready, goal.name, keys))
    classes = 2
    if goal.task == "classification":
        classes = int(ready.agg(F.max(goal.name)).first()[0]) + 1
    name, estimator = training.winner(board, goal.task, classes, width)
    model = training.finalize(estimator, clean, goal.name, exclude=keys, stages=[stage])
    names = model.stages[-2].getInputCols()
    last = model.stages[-1]
    if set(training.vector_columns(ready)) & set(names):
        # Categories with very many values: the model's own weights, added up for each column.
        importance = explaining.grouped_importance(model, ready)
        if importance is not None:
            return Outcome(goal, chosen, checks, verdict, encoder, board, name, model, importance.withColumn("most_rows", F.lit(0)))
        names = [n for n in names if n not in training.vector_columns(ready)]
    if goal.task == "regression" and hasattr(last, "coefficients"):
        explained = training.filter_null_target(ready, goal.name)
        rows = explained.count()
        phi = explaining.linear_attribution(explained, keys, dict(zip(names, map(float, last.coefficients))))
    elif is_tree(model):
        explained = training.filter_null_target(ready, goal.name)
        rows = explained.count()
        phi = tree_attribution(model, explained, keys, classes if goal.task == "classification" else 0)
    else:
        sample, rows = explaining.explain_sample(ready, keys, explained_rows), explained_rows
        inner = PipelineModel(stages=model.stages[1:])
        output = explaining.class_outputs(inner, classes) if goal.task == "classification" else None
        phi = explaining.shapley_by_permutation(inner, sample, keys, names, output, permutations, background_rows)
    importance = explaining.global_importance(phi).withColumn("most_rows", F.lit(rows))
    return Outcome(goal, chosen, checks, verdict, encoder, board, name, model, importance)


def run_file(spark: SparkSession, path: str, keys: Sequence[str], **options) -> Outcome:
    return run_table(tables.scan_csv(spark, path), keys, **options)


def save_outcome(outcome: Outcome, spark: SparkSession, path: str | None = None) -> str:
    """Model, encoder parameters and reports under one folder."""
    path = path or new_path(spark, "run")
    outcome.model.write().overwrite().save(f"{path}/model")
    tables.save_params(outcome.encoder.to_params(spark), f"{path}/encoder")
    tables.write_report(outcome.checks, f"{path}/validation")
    tables.write_report(outcome.leaderboard, f"{path}/leaderboard")
    tables.write_report(outcome.importance, f"{path}/importance")
    return path
