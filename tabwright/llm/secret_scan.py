"""Secrets: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Patterns find assignments to names like `password`, access keys and long hex strings.  The random field
tags every token as begin, inside or outside of a secret from its shape, the neighbouring tokens and the
kind of text, decoded by Viterbi.  It is fitted on tokens of at most `sample_rows` texts, labelled by the
patterns; a stretch that it tags is a span of kind `model` unless it touches a span of a pattern.

Spans are code points, end exclusive, of whole texts.  Null and empty texts have none.  Rows are scanned
one by one, so ties and repeated rows do not matter; without any secret to learn from the random field adds
nothing.  Columns other than the keys and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import crf
from .words import passed_on, slices

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
TOKEN = re.compile(r"[\w+/-]+|[^\w\s]")
SAMPLE_ROWS, EXAMPLES = 40_000, 200_000

# Words that stand before secrets.
KEY_WORDS = frozenset(
    "password passwd secret token apikey api_key key auth bearer credential credentials passphrase pwd login access private".split()
)
BOUNDS = (6, 12, 16, 20, 24, 32, 40)
SHAPES = (
    (re.compile("[a-z]+"), 0), (re.compile("[A-Za-z]+"), 1), (re.compile("[0-9]+"), 2), (re.compile("[0-9a-f]+"), 3),
    (re.compile("[0-9A-Z]+"), 4), (re.compile("[0-9A-Za-z]+"), 5), (re.compile(r"[0-9A-Za-z+/_-]+"), 6), (re.compile("[=:]"), 7),
    (re.compile("[\"'`]"), 8), (re.compile(r"[^\w\s]"), 9),
)
OTHER_SHAPE, KEY_SHAPE, SHAPE_COUNT = 10, 11, 12
SIZES = len(BOUNDS) + 1
CATEGORIES, TEXT_KINDS, LABELS = SHAPE_COUNT * SIZES, 3, 3
BEGIN, INSIDE = 1, 2


def category(token: str) -> int:
    """Shape and length; key words are one category."""
    if token.lower() in KEY_WORDS:
        return KEY_SHAPE * SIZES
    shape = next((s for p, s in SHAPES if p.fullmatch(token)), OTHER_SHAPE)
    return shape * SIZES + int(np.searchsorted(BOUNDS, len(token), side="right"))


def text_kinds(cats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """0: no assignment sign, 1: some, 2: every tenth token or more is one."""
    shape = cats // SIZES
    signs = np.concatenate([np.zeros(1, np.int64), np.cumsum(shape == 7)])
    signs = signs[starts[1:]] - signs[starts[:-1]]
    return (signs > 0).astype(np.int64) + (signs * 10 >= np.maximum(np.diff(starts), 1)) * (signs > 0)


def pattern_spans(text: str | None, may_hold_hex: bool = True) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of each pattern, by start and kind."""
    found = []
    if not text:
        return found
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if may_hold_hex:
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def token_labels(text: str, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Begin, inside or outside for each token, as the patterns say."""
    places = [m.span() for m in TOKEN.finditer(text)]
    first, end = np.array([p[0] for p in places]), np.array([p[1] for p in places])
    labels = np.zeros(len(places), np.int64)
    for _, _, stop, start in spans:
        inside = np.flatnonzero((end > start) & (first < stop))
        if len(inside) and not labels[inside].any():
            labels[inside], labels[inside[0]] = INSIDE, BEGIN
    return labels


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, examples: int = EXAMPLES) -> crf.Weights | None:
    """Weights from a bounded sample; None if it holds no secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        categories = crf.Categories(category)
        for b in slices(batches, "body"):
            texts = b.column("body").to_pylist()
            cats, starts = crf.categorised(texts, TOKEN, categories)
            kinds = text_kinds(cats, starts)
            near = np.stack(crf.neighbours(cats, starts, CATEGORIES, SIZES), axis=1)
            rows = []
            for i, t in enumerate(texts):
                s, e = starts[i], starts[i + 1]
                if s == e:
                    continue
                spans = pattern_spans(t)
                labels = token_labels(t, spans) if spans else np.zeros(e - s, np.int64)
                around = np.convolve(labels > 0, np.ones(7, int))[3 : 3 + len(labels)] > 0
                rare = np.isin(cats[s:e] // SIZES, (2, 3, 4, 5, 6, 7, 8, KEY_SHAPE))
                some = (np.arange(e - s) + i) % 50 == 0  # and every fiftieth ordinary token
                at = np.flatnonzero(around | rare | some)
                edge = np.concatenate([np.zeros(1, np.int64), labels, np.zeros(1, np.int64)])
                rows.append(np.column_stack([labels[at], near[s:e][at], np.full(len(at), kinds[i]), edge[at], edge[at + 2], np.zeros((len(at), LABELS), np.int64)]))
            if rows:
                values = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(values.tolist(), pa.list_(pa.int32()))], names=["example"])

    found = crf.sampled(docs, doc_id, text, sample_rows).mapInArrow(run, "example array<int>")
    values = crf.bounded(found, examples)
    if not len(values) or not (values[:, 0] == BEGIN).any():
        return None
    weights = crf.fit(values, CATEGORIES, SIZES, TEXT_KINDS, LABELS)
    weights.moves[crf.OUTSIDE, INSIDE] = crf.NEVER
    return weights


def scan(docs: DataFrame, weights: crf.Weights | None, keys: Sequence[str | Column] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns and spans array<struct<kind, start, end>>, sorted by start, then kind."""
    source = docs.select(*keys, F.col(text).alias("body__"))
    names = [f.name for f in source.schema.fields[:-1]]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        categories = crf.Categories(category)
        for b in slices(batches, "body__"):
            texts = b.column("body__").to_pylist()
            hexes = pc.fill_null(pc.match_substring_regex(b.column("body__"), "[0-9a-f]{24}"), False).to_pylist()
            spans = [pattern_spans(t, h) for t, h in zip(texts, hexes)]
            if weights is not None:
                cats, starts = crf.categorised(texts, TOKEN, categories)
                scores = weights.emissions(cats, starts, text_kinds(cats, starts))
                for i, s, e in crf.stretches(weights.open_tokens(scores, starts), starts):
                    labels = crf.viterbi(scores[s:e], weights.moves)
                    if any(labels):
                        places = [m.span() for m in TOKEN.finditer(texts[i])][s - starts[i] : e - starts[i]]
                        spans[i] = added(spans[i], labels, places)
            out = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in found] for found in spans]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(span))], names=[*names, "spans"])

    return source.mapInArrow(run, passed_on(source, "spans array<struct<kind:string,start:int,end:int>>"))


def added(spans: list[tuple[int, int, int, int]], labels: list[int], places: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """The spans with those of tagged tokens that touch none of them."""
    new: list[list[int]] = []
    for label, (s, e) in zip([*labels, crf.OUTSIDE], [*places, (0, 0)]):
        if label == BEGIN:
            new.append([s, e])
        elif label == INSIDE and new:
            new[-1][1] = e
    free = [(s, 3, e, s) for s, e in new if all(e <= a or s >= b for a, _, b, _ in spans)]
    return sorted(spans + free)
