"""Exact model metrics as aggregates over (label, prediction) columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.columns import col, count_where
from ..functions.sizing import DRIVER_ROWS, rows_if_bounded, slotted

#: Scores of one range of a group (about), of one sorted piece of a task, and of the sample that gives the ranges.
RANGE_ROWS = 500_000
RUN_ROWS = 1_000_000
RANGE_SAMPLE = 100_000
FEW_CODES = 1 << 15  # sorted in linear time


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str, positive: object = 1) -> DataFrame:
    """(n, accuracy, precision, recall, f1) for the positive class."""
    y, p = col(label) == F.lit(positive), col(prediction) == F.lit(positive)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"),
        count_where(y & p).alias("tp"),
        count_where(~y & p).alias("fp"),
        count_where(y & ~p).alias("fn"),
    )
    none = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), none)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), none)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), none)
    return row.select("n", "accuracy", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def weighted_metrics(cells: Iterable[tuple[int, int, int]]) -> dict[str, float]:
    """Accuracy and support-weighted precision, recall and F1 of a confusion matrix."""
    support, predicted, hits = Counter(), Counter(), Counter()
    for label, guess, n in cells:
        support[label] += n
        predicted[guess] += n
        if label == guess:
            hits[label] += n
    total = sum(support.values())
    share = lambda part: sum(support[c] * part(c) for c in support) / total
    return {
        "accuracy": sum(hits.values()) / total,
        "precision": share(lambda c: hits[c] / predicted[c] if predicted[c] else 0.0),
        "recall": share(lambda c: hits[c] / support[c]),
        "f1": share(lambda c: 2 * hits[c] / (predicted[c] + support[c])),
    }


def auc(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """(auc): chance that a positive outscores a negative, ties counting half.

    Rows collapse to one per distinct score first.  Many distinct scores are
    split into score ranges, and each range adds what lies below it.
    """
    hit = (col(label) == F.lit(positive)).cast("bigint")
    scores = df.groupBy(col(score).alias("s")).agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("q"))
    if rows_if_bounded(scores, DRIVER_ROWS) is None:
        ranged = slotted(scores, ["s"])
    else:
        ranged = scores.withColumn("__slot", F.lit(0))
    totals = ranged.groupBy("__slot").agg(F.sum("q").alias("q_slot"))
    earlier = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__slot", F.coalesce(F.sum("q_slot").over(earlier), F.lit(0)).alias("q_before"))
    below = Window.partitionBy("__slot").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.col("q_before") + F.coalesce(F.sum("q").over(below), F.lit(0))
    placed = ranged.join(F.broadcast(starts), "__slot").withColumn("lower", lower)  # one row per range
    wins = F.sum(F.col("p") * (F.col("lower") + F.col("q") / 2.0))
    return placed.agg(F.try_divide(wins, F.sum("p") * F.sum("q").cast("double")).alias("auc"))


def _regression(label: str, prediction: str) -> list:
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    return [
        F.count(F.lit(1)).alias("n"),
        (1.0 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))).alias("mape"),
    ]


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(n, r2, rmse, mae, mape); zero labels do not enter MAPE."""
    return df.agg(*_regression(label, prediction))


def regression_scores(df: DataFrame, groups: list[str], label: str, prediction: str) -> DataFrame:
    """The same for each group."""
    return df.groupBy(*groups).agg(*_regression(label, prediction))


def regression_scores_wide(df: DataFrame, groups: list[str], label: str, predictions: list[str]) -> DataFrame:
    """The same for each group and several predictions of a row: one struct column for each of them."""
    return df.groupBy(*groups).agg(*[F.struct(*_regression(label, p)).alias(p) for p in predictions])


def tied(values: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order with their sums of p and q; NaN is one value, the largest."""
    order = np.argsort(values, kind="stable")  # runs that are sorted already are merged
    values, p, q = values[order], p[order], q[order]
    same = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
    first = np.concatenate([np.zeros(min(len(values), 1), np.int64), np.flatnonzero(~same) + 1])
    return (values[first], np.add.reduceat(p, first), np.add.reduceat(q, first)) if len(first) else (values, p, q)


def _ranges(df: DataFrame, groups: list[str], rows: int) -> dict[tuple, np.ndarray]:
    """group -> inner bounds of its score ranges, from a sample of all `rows`; groups of one range are left out."""
    sample = df.limit(2 * RANGE_SAMPLE).collect()  # bounded; any bounds give the same areas
    found: dict[tuple, list[float]] = {}
    for r in sample:
        if r["s"] is not None:
            found.setdefault(tuple(r)[: len(groups)], []).append(r["s"])
    out = {}
    for key, values in found.items():
        parts = -(-len(values) * rows // (len(sample) * RANGE_ROWS))
        if parts > 1:
            out[key] = np.unique(np.quantile(values, np.arange(1, parts) / parts, method="nearest"))
    return out


def auc_by(df: DataFrame, groups: list[str], label: str, score: str, rows: int | None = None, sample: DataFrame | None = None) -> DataFrame:
    """(groups, auc) for every group at once; `label` is 0 or 1, `rows` their number if it is known, `sample` some of them.

    Tasks sort the scores of each group in large pieces and send them as arrays, equal scores once; one shuffle
    brings a score range of a group together, and each range adds what lies below it.
    """
    y = col(label).cast("bigint")
    hits = [F.coalesce(c, F.lit(0).cast("bigint")).alias(n) for c, n in ((y, "p"), (1 - y, "q"))]
    scores = df.select(*[col(g) for g in groups], col(score).cast("double").alias("s"), *hits)
    rows = df.count() if rows is None else rows
    if sample is None and rows > RANGE_ROWS:
        sample = df.sample(min(1.0, RANGE_SAMPLE / rows), 42)
    bounds = _ranges(sample.select(*[col(g) for g in groups], col(score).cast("double").alias("s")), groups, rows) if rows > RANGE_ROWS else {}
    kinds = [scores.schema[g] for g in groups]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sorted_runs() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            code, most = np.zeros(whole.num_rows, np.int64), 1
            for g in groups:
                own = pc.dictionary_encode(whole.column(g).combine_chunks(), null_encoding="encode")
                code, most = code * len(own.dictionary) + own.indices.to_numpy(), most * len(own.dictionary)
                if most > FEW_CODES:
                    found, code = np.unique(code, return_inverse=True)
                    most = len(found)
            order = np.argsort(code.astype(np.int16) if most <= FEW_CODES else code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order], prepend=-1)).tolist() + [len(order)]
            missing = whole.column("s").is_null().to_numpy()
            s, p, q = (pc.fill_null(whole.column(c), 0).to_numpy() for c in ("s", "p", "q"))
            first, slots, found = [], [], []
            for a, b in zip(edges, edges[1:]):
                mine = order[a:b]
                key = tuple(whole.column(g)[int(mine[0])].as_py() for g in groups)
                none, mine = mine[missing[mine]], mine[~missing[mine]]
                parts = [(-1, (np.zeros(1), p[none].sum(keepdims=True), q[none].sum(keepdims=True)))] if len(none) else []
                values = tied(s[mine], p[mine], q[mine])
                cuts = [0, *np.searchsorted(values[0], bounds.get(key, np.zeros(0)), side="right").tolist(), len(values[0])]
                parts += [(i, tuple(v[c:d] for v in values)) for i, (c, d) in enumerate(zip(cuts, cuts[1:])) if c < d]
                for slot, arrays in parts:
                    first.append(int(order[a]))
                    slots.append(slot)
                    found.append([v.astype(t).tobytes() for v, t in zip(arrays, ("<f8", "<i8", "<i8"))])
            at = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[whole.column(g).combine_chunks().take(at) for g in groups], pa.array(slots, pa.int32()), *[pa.array([f[i] for f in found], pa.binary()) for i in range(3)]],
                names=[*groups, "__slot", "s", "p", "q"],
            )

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= RUN_ROWS:
                yield from sorted_runs()
        if held:
            yield from sorted_runs()

    def merged(table: pa.Table) -> pa.Table:
        arrays = [np.concatenate([np.frombuffer(v.as_py(), t) for v in table.column(c)]) for c, t in (("s", "<f8"), ("p", "<i8"), ("q", "<i8"))]
        _, p, q = tied(*arrays)
        wins = float((p * ((np.cumsum(q) - q) + q / 2.0)).sum())
        return table.slice(0, 1).select([*groups, "__slot"]).append_column("p", pa.array([int(p.sum())])).append_column(
            "q", pa.array([int(q.sum())])).append_column("wins", pa.array([wins]))

    keys = [*kinds, T.StructField("__slot", T.IntegerType())]
    binary = [T.StructField(c, T.BinaryType()) for c in ("s", "p", "q")]
    sums = [T.StructField("p", T.LongType()), T.StructField("q", T.LongType()), T.StructField("wins", T.DoubleType())]
    ranged = scores.mapInArrow(runs, T.StructType(keys + binary)).groupBy(*groups, "__slot").applyInArrow(merged, T.StructType(keys + sums))
    earlier = Window.partitionBy(*groups).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("below", F.coalesce(F.sum("q").over(earlier), F.lit(0)))  # one row per range
    wins = F.sum(F.col("wins") + F.col("p") * F.col("below").cast("double"))
    return placed.groupBy(*groups).agg(F.try_divide(wins, F.sum("p") * F.sum("q").cast("double")).alias("auc"))
