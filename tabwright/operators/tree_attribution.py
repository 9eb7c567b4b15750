"""Exact attribution of tree models, for all rows: path-dependent Shapley values.

A leaf's path holds conditions on a few features.  For feature j let z_j be the share of training rows that
go the path's way at its nodes (product of cover ratios) and o_j be 1 if the row meets its conditions, else
0.  With a coalition S known, the leaf counts with the product of o over S and z over the rest, so its
Shapley value for feature i is

    value * (o_i - z_i) * integral over t in (0, 1) of the product over j != i of (z_j (1 - t) + o_j t),

because that integral gives each coalition its weight |S|! (m - |S| - 1)! / m!.  The integrand has degree
m - 1, so a Gauss rule with m / 2 points is exact.  Rows are handled in batches, one array operation for
each leaf; no coalition is listed and no background row is needed.  The attributions of a row and the base
value add up to the model's output.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col


@dataclass
class Condition:
    """What a path asks of one feature: within (low, high], or one of `allowed`; `share` is its z."""

    feature: int
    low: float = -np.inf
    high: float = np.inf
    allowed: frozenset | None = None
    share: float = 1.0

    def met(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        if self.high < np.inf:
            found &= x <= self.high
        if self.low > -np.inf:
            found &= ~(x <= self.low)  # a NaN goes to the right
        if self.allowed is not None:
            found &= np.isin(x, list(self.allowed))
        return found


@dataclass
class Leaf:
    value: np.ndarray
    path: dict[int, Condition]

    def base(self) -> np.ndarray:
        return self.value * np.prod([c.share for c in self.path.values()])


def is_tree(model: PipelineModel) -> bool:
    last = model.stages[-1]
    return hasattr(last, "trees") or hasattr(last, "numNodes")


def leaves_of(model: PipelineModel, classes: int = 0) -> list[Leaf]:
    """The leaves of a tree, forest or boosted model.

    Without `classes`, or for boosted trees, a leaf's value is its prediction (for a boosted classifier the
    margin is explained); with classes it is the probability of each class, of the second for two.
    """
    last = model.stages[-1]
    trees = last.trees if hasattr(last, "trees") else [last]
    boosted = "GBT" in type(last).__name__
    weights = last.treeWeights if boosted else [1 / len(trees)] * len(trees)
    leaves: list[Leaf] = []
    for tree, weight in zip(trees, weights):
        stack = [(tree._call_java("rootNode"), {})]
        while stack:
            node, path = stack.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                leaves.append(Leaf(weight * leaf_value(node, 0 if boosted else classes), path))
                continue
            split, cover = node.split(), node.impurityStats().count()
            feature = split.featureIndex()
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                share = child.impurityStats().count() / cover
                stack.append((child, path | {feature: narrowed(path.get(feature, Condition(feature)), split, left, share)}))
    return leaves


def leaf_value(node, classes: int) -> np.ndarray:
    if not classes:
        return np.array([node.prediction()])
    counts = np.array(list(node.impurityStats().stats()), float)
    p = counts / counts.sum()
    return p[1:2] if classes == 2 else p


def narrowed(known: Condition, split, left: bool, share: float) -> Condition:
    """A condition after one more split on its feature."""
    share *= known.share
    if split.getClass().getSimpleName() == "CategoricalSplit":
        own = frozenset(split.leftCategories() if left else split.rightCategories())
        return Condition(known.feature, known.low, known.high, own if known.allowed is None else known.allowed & own, share)
    t = split.threshold()
    low, high = (known.low, min(known.high, t)) if left else (max(known.low, t), known.high)
    return Condition(known.feature, low, high, known.allowed, share)


def attributed(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """(rows, features, outputs) of the Shapley values of rows of features."""
    outputs = len(leaves[0].value) if leaves else 1
    phi = np.zeros((*x.shape, outputs))
    rules: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for leaf in leaves:
        conditions = list(leaf.path.values())
        m = len(conditions)
        if not m:
            continue
        if m not in rules:
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            rules[m] = ((points + 1) / 2, weights / 2)
        met = np.stack([c.met(x[:, c.feature]) for c in conditions], 1).astype(float)
        share = np.array([c.share for c in conditions])
        others = np.zeros_like(met)
        for t, w in zip(*rules[m]):
            factor = share * (1 - t) + met * t
            ahead = np.cumprod(np.hstack([np.ones((len(x), 1)), factor[:, :-1]]), 1)
            behind = np.cumprod(np.hstack([np.ones((len(x), 1)), factor[:, :0:-1]]), 1)[:, ::-1]
            others += w * ahead * behind
        part = (met - share) * others
        for j, c in enumerate(conditions):
            phi[:, c.feature] += part[:, j, None] * leaf.value
    return phi


def base_value(leaves: Sequence[Leaf]) -> np.ndarray:
    """The model's output before any feature is known: the mean of its leaves by their covers."""
    return sum((leaf.base() for leaf in leaves), np.zeros(1))


def tree_attribution(model: PipelineModel, df: DataFrame, keys: Sequence[str], classes: int = 0) -> DataFrame:
    """(keys, feature, phi) of every row; phi is an array of one value a class for three classes or more."""
    features = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    leaves = leaves_of(model, classes)
    several = bool(leaves) and len(leaves[0].value) > 1
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            phi = attributed(x, leaves)
            held = pa.array((phi if several else phi[:, :, 0]).tolist(), pa.list_(pa.list_(pa.float64()) if several else pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], held], names=[*b.schema.names[:-1], "__phi"])

    vector = F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in features])
    rows = df.select(*[col(k) for k in keys], vector.alias("__x"))
    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    done = rows.mapInArrow(run, f"{kept}, __phi array<{'array<double>' if several else 'double'}>")
    named = F.arrays_zip(F.array(*[F.lit(c) for c in features]).alias("feature"), F.col("__phi").alias("phi"))
    return done.select(*[col(k) for k in keys], F.inline(named)).toDF(*keys, "feature", "phi")
