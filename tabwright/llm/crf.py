"""Conditional random fields over token categories: the part that the secret and the personal-data scans share.

A token is known by its category (its shape, length and whether it is a key word), so the weights are small
tables: category here, one and two tokens before, one token behind, the text's own kind, the label before.
Weights are fitted by pseudo-likelihood on a bounded sample of tokens whose labels the patterns give.

Decoding is exact and yet cheap: `open_tokens` bounds what any stretch of labels other than "outside" could
gain, with the largest sum of a stretch through each token; tokens that cannot gain are outside in the best
labelling, and only the few others are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .words import CACHED_WORDS

OUTSIDE = 0
OFFSETS = (0, -1, -2, 1)
TABLES = len(OFFSETS) + 1  # and one for the coarse category here
NEVER = -1e4


@dataclass
class Weights:
    tables: list[np.ndarray]  # category x label for each offset, coarse category x label
    kinds: np.ndarray  # kind of text x label
    moves: np.ndarray  # label before x label
    coarse: int  # categories to a coarse one
    skip: float = 0.0  # gain of two linked tokens with the same label other than outside

    def emissions(self, cats: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Token x label, for a batch of texts."""
        total = self.kinds[kinds].repeat(np.diff(starts), axis=0)
        for table, near in zip(self.tables, neighbours(cats, starts, len(self.tables[0]) - 1, self.coarse)):
            total += table[near]
        return total

    def open_tokens(self, scores: np.ndarray, starts: np.ndarray, linked: np.ndarray | None = None) -> np.ndarray:
        """Tokens that may be labelled otherwise than outside; all others are outside in the best labelling."""
        if not len(scores):
            return np.zeros(0, bool)
        stay = self.moves[OUTSIDE, OUTSIDE]
        inner = self.moves[1:, 1:].max() - stay
        edges = self.moves[OUTSIDE, 1:].max() + self.moves[1:, OUTSIDE].max() - 2 * stay
        gain = scores[:, 1:].max(axis=1) - scores[:, OUTSIDE] + inner
        if linked is not None:
            gain = gain + linked * 2 * max(self.skip, 0.0)  # a link before and one behind
        walls = np.full(len(gain) + len(starts), -1e6)
        places = np.arange(len(gain)) + np.repeat(np.arange(1, len(starts)), np.diff(starts))
        walls[places] = gain
        through = best_ending(walls) + best_ending(walls[::-1])[::-1] - walls
        return through[places] + edges - inner > -1e-6


def best_ending(gain: np.ndarray) -> np.ndarray:
    """The largest sum of a stretch that ends at each place."""
    total = np.cumsum(gain)
    before = np.concatenate([np.zeros(1), total[:-1]])
    return total - np.minimum.accumulate(before)


def neighbours(cats: np.ndarray, starts: np.ndarray, edge: int, coarse: int) -> list[np.ndarray]:
    """Categories at OFFSETS of every token, `edge` beyond its text; then the coarse category."""
    n, out = len(cats), []
    at = np.arange(n)
    first, end = np.repeat(starts[:-1], np.diff(starts)), np.repeat(starts[1:], np.diff(starts))
    for offset in OFFSETS:
        near = at + offset
        inside = (near >= first) & (near < end)
        out.append(np.where(inside, cats[np.clip(near, 0, max(n - 1, 0))], edge) if n else cats)
    return [*out, cats // coarse]


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best labels of a stretch that stands between outside tokens."""
    best, back = scores[0] + moves[OUTSIDE], []
    for row in scores[1:]:
        step = best[:, None] + moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    label = int((best + moves[:, OUTSIDE]).argmax())
    labels = [label]
    for choice in reversed(back):
        labels.append(label := int(choice[label]))
    return labels[::-1]


def stretches(mask: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, first, end) of the runs of marked tokens, cut at texts."""
    where = np.flatnonzero(mask)
    if len(where):
        text = np.searchsorted(starts, where, side="right") - 1
        cuts = np.flatnonzero((np.diff(where) > 1) | (np.diff(text) > 0)) + 1
        for part in np.split(np.arange(len(where)), cuts):
            yield int(text[part[0]]), int(where[part[0]]), int(where[part[-1]]) + 1


def fit(examples: np.ndarray, categories: int, coarse: int, kinds: int, labels: int, steps: int = 150, penalty: float = 1e-5, rate: float = 0.3) -> Weights:
    """Pseudo-likelihood: each token's label given its surroundings and the labels next to it (Adam, full batch).

    examples, a row a token: label, categories as `neighbours` gives them, kind of text, label before, label behind, then for
    each label the number of linked tokens that have it.
    """
    y, cats, kind = examples[:, 0], examples[:, 1 : 1 + TABLES], examples[:, 1 + TABLES]
    before, behind = examples[:, 2 + TABLES], examples[:, 3 + TABLES]
    links = examples[:, 4 + TABLES :].astype(float)
    links[:, OUTSIDE] = 0
    n = len(y)
    shapes = [(categories + 1, labels)] * TABLES + [(kinds, labels), (labels, labels), (1,)]
    params = [np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    truth = np.eye(labels)[y]
    weight = 1.0 / np.bincount(y, minlength=labels)[y] ** 0.5
    weight = (weight / weight.sum())[:, None]

    def by(index: np.ndarray, size: int, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(index, rows[:, k], size) for k in range(labels)], axis=1)

    for step in range(1, steps + 1):
        *tables, by_kind, moves, skip = params
        logits = by_kind[kind] + moves[before] + moves[:, behind].T + skip[0] * links
        for table, c in zip(tables, cats.T):
            logits += table[c]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        wrong = (truth - p / p.sum(axis=1, keepdims=True)) * weight
        grads = [by(c, categories + 1, wrong) for c in cats.T]
        grads += [by(kind, kinds, wrong), by(before, labels, wrong) + by(behind, labels, wrong).T, np.array([(wrong * links).sum()])]
        for i, g in enumerate(grads):
            g = g - penalty * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    *tables, by_kind, moves, skip = params
    return Weights(tables, by_kind, moves, coarse, float(skip[0]))


def sampled(docs: DataFrame, doc_id: str, text: str, rows: int) -> DataFrame:
    """body of at most about `rows` rows, the first by a hash of their id (repeated ids stay together)."""
    named = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    ids = named.select("id").where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(rows).distinct()
    return named.join(F.broadcast(ids), "id").select("body")  # at most `rows` ids


def bounded(found: DataFrame, examples: int) -> np.ndarray:
    """At most `examples` rows of `example`: half of them with a label other than outside, the first by a hash."""
    mixed = found.withColumn("at", F.xxhash64("example", F.monotonically_increasing_id()))
    halves = [mixed.where(c).orderBy("at").select("example").limit(examples // 2) for c in (found.example[0] > 0, found.example[0] == 0)]
    return np.array([r["example"] for half in halves for r in half.collect()], np.int64)


class Categories(dict):
    """token -> category; forgets everything when it is full."""

    def __init__(self, of: Callable[[str], int]):
        self.of = of

    def __missing__(self, token: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[token] = self.of(token)
        return found


def categorised(texts: list[str | None], pattern: re.Pattern, categories: Categories) -> tuple[np.ndarray, np.ndarray]:
    """(category of every token, starts)."""
    parts, starts, look = [], np.zeros(len(texts) + 1, np.int64), categories.__getitem__
    for i, text in enumerate(texts):
        tokens = pattern.findall(text) if text else []
        starts[i + 1] = starts[i] + len(tokens)
        if tokens:
            parts.append(np.fromiter(map(look, tokens), np.int64, len(tokens)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), starts
