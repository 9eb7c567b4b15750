"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Patterns find e-mail addresses, IP addresses, payment cards (with their check digit) and phone numbers.
In the random field tokens are linked to their neighbours, and tokens with digits or an @ also to the next
token of the text that is the same but for case and punctuation, however far away.  Linked tokens share a
potential that favours one label, and loopy message passing settles the labels of a text together: a
number that was found once as part of a phone number is marked where it stands alone.  Tokens of pattern
spans are evidence and keep their labels.  Links go from one occurrence to the next, so their number is
that of the tokens, however often one repeats.

Weights, that of the links included, are fitted on tokens of at most `sample_rows` texts, labelled by the
patterns.  Added spans have the kinds of the patterns and never touch a pattern's span.  Spans are code
points, end exclusive, of whole texts.  Null and empty texts have none; without anything to learn from the
random field adds nothing.  Rows are scanned one by one; columns other than the keys and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import crf
from .words import passed_on, slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
DIGIT_OR_AT = re.compile("[0-9@]")
TOKEN = re.compile(r"[\w@.%+-]+|[^\w\s]")
NOT_KEY = re.compile(r"[^0-9a-z@]+")
SAMPLE_ROWS, EXAMPLES = 40_000, 200_000
#: Messages end when none moves by more; the rounds are no cap but what a text of so many nodes may need.
SETTLED, ROUNDS, ROUNDS_A_NODE = 1e-3, 20, 10

BOUNDS = (3, 4, 6, 9, 12, 15, 20)
SIZES = len(BOUNDS) + 1
SHAPES = (
    (re.compile(r"[^\W\d_]+\.?"), 0), (re.compile(r"\+[0-9]+"), 1), (re.compile(r"[0-9]+\.?"), 2), (re.compile("[0-9]+(-[0-9]+)+"), 3),
    (re.compile(r"[0-9]+(\.[0-9]+){3}\.?"), 4), (re.compile(r"[0-9]+(\.[0-9]+)+\.?"), 5), (re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+"), 6),
    (re.compile(r"[\w.%+-]*@[\w.%+-]*"), 7), (re.compile(r"[(]"), 8), (re.compile(r"[)]"), 9), (re.compile(r"[^\w\s]"), 10), (re.compile(r"\w*[0-9][\w.%+-]*"), 11),
)
OTHER_SHAPE, CHECKED_SHAPE, SHAPE_COUNT = 12, 13, 14
LINKED_SHAPES = (1, 2, 3, 4, 5, 6, 7, 11, CHECKED_SHAPE)
WORD = 0
CATEGORIES, TEXT_KINDS, LABELS = SHAPE_COUNT * SIZES, 2, 1 + len(KINDS)


def category(token: str) -> int:
    """Shape and length; digits that pass the check of card numbers are a shape of their own."""
    digits = token.rstrip(".")
    if 13 <= len(digits) <= 19 and digits.isascii() and digits.isdigit() and luhn(digits):
        return CHECKED_SHAPE * SIZES
    shape = next((s for p, s in SHAPES if p.fullmatch(token)), OTHER_SHAPE)
    return (shape * SIZES) if shape == 0 else shape * SIZES + int(np.searchsorted(BOUNDS, len(token), side="right"))


def text_kinds(cats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1: the text holds an @ or a plus sign with digits."""
    marks = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.isin(cats // SIZES, (1, 6, 7)))])
    return (marks[starts[1:]] > marks[starts[:-1]]).astype(np.int64)


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def pattern_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of each pattern, by kind and start; linear in the length of the text."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return found
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        found += [(1, *m.span()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def token_labels(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each token (0 or 1 + kind); the first kind wins where patterns overlap."""
    labels = np.zeros(len(places), np.int64)
    if spans:
        first, end = np.array([p[0] for p in places]), np.array([p[1] for p in places])
        for kind, start, stop in reversed(spans):
            labels[np.searchsorted(end, start, side="right") : np.searchsorted(first, stop)] = 1 + kind
    return labels


def skip_links(tokens: list[str], wanted: np.ndarray) -> list[tuple[int, int]]:
    """(earlier, later): from each wanted token to the next one that is the same but for case and punctuation."""
    last: dict[str, int] = {}
    links = []
    for i in wanted.tolist():
        key = NOT_KEY.sub("", tokens[i].lower())
        if len(key) >= 3:
            if key in last:
                links.append((last[key], i))
            last[key] = i
    return links


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, examples: int = EXAMPLES) -> crf.Weights | None:
    """Weights from a bounded sample; None if it holds no personal data."""

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
                linked = np.isin(cats[s:e] // SIZES, LINKED_SHAPES)
                labels, links = np.zeros(e - s, np.int64), np.zeros((e - s, LABELS), np.int64)
                if linked.any():
                    found = list(TOKEN.finditer(t))
                    labels = token_labels([m.span() for m in found], pattern_spans(t))
                    for p, q in skip_links([m[0] for m in found], np.flatnonzero(linked)):
                        links[p, labels[q]] += 1
                        links[q, labels[p]] += 1
                around = np.convolve(labels > 0, np.ones(7, int))[3 : 3 + len(labels)] > 0
                some = (np.arange(e - s) + i) % 50 == 0  # and every fiftieth ordinary token
                at = np.flatnonzero(around | linked | some)
                edge = np.concatenate([np.zeros(1, np.int64), labels, np.zeros(1, np.int64)])
                seen = np.column_stack([labels[at], near[s:e][at], np.full(len(at), kinds[i]), edge[at], edge[at + 2], links[at]])
                # Parts of longer entities once more among ordinary words: with a link to a token of their
                # label they keep it, without one they are outside.
                part = (labels[at] > 0) & linked[at] & ((edge[at] > 0) | (edge[at + 2] > 0))
                moved = np.repeat(seen[part], 2, axis=0)
                moved[:, 2 : 1 + len(crf.OFFSETS)] = WORD
                moved[:, 2 + crf.TABLES :] = crf.OUTSIDE
                moved[::2, 4 + crf.TABLES :] = np.eye(LABELS, dtype=np.int64)[moved[::2, 0]]
                moved[1::2, 0] = crf.OUTSIDE
                rows += [seen, moved]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).tolist(), pa.list_(pa.int32()))], names=["example"])

    values = crf.bounded(crf.sampled(docs, doc_id, text, sample_rows).mapInArrow(run, "example array<int>"), examples)
    if not len(values) or not (values[:, 0] > 0).any():
        return None
    return crf.fit(values, CATEGORIES, SIZES, TEXT_KINDS, LABELS)


def settled(scores: np.ndarray, nodes: np.ndarray, given: np.ndarray, links: list[tuple[int, int]], weights: crf.Weights) -> np.ndarray:
    """Labels of the nodes (token numbers in order) by loopy sum-product messages until they settle.

    given: a label for each node, or -1.  Tokens that are not nodes are outside.  Evidence moves one edge a
    round, half of it at once, so a text gets as many rounds as its nodes need; messages that still move
    then go round in circles, and the last ones count.
    """
    place = {int(n): i for i, n in enumerate(nodes)}
    alone = scores[nodes].copy()
    for i, n in enumerate(nodes.tolist()):
        if n - 1 not in place:
            alone[i] += weights.moves[crf.OUTSIDE]
        if n + 1 not in place:
            alone[i] += weights.moves[:, crf.OUTSIDE]
        if given[i] >= 0:
            alone[i] = np.where(np.arange(LABELS) == given[i], 0.0, crf.NEVER)
    same = np.diag([0.0] + [max(weights.skip, 0.0)] * (LABELS - 1))
    beside = {p for p, q in links if q == p + 1}  # neighbours that are linked too have one edge with both potentials
    edges = [(place[n], place[n + 1], weights.moves + same if n in beside else weights.moves) for n in place if n + 1 in place]
    edges += [(place[p], place[q], same) for p, q in links if p in place and q in place and q != p + 1]
    if not edges:
        return alone.argmax(axis=1)
    source = np.array([e[0] for e in edges] + [e[1] for e in edges])
    goal = np.array([e[1] for e in edges] + [e[0] for e in edges])
    tables = np.stack([e[2] for e in edges] + [e[2].T for e in edges])  # from source to goal
    back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
    messages = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS + ROUNDS_A_NODE * len(nodes)):
        belief = alone.copy()
        np.add.at(belief, goal, messages)
        out = (belief[source] - messages[back])[:, :, None] + tables
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        if moved < SETTLED:
            break
    belief = alone.copy()
    np.add.at(belief, goal, messages)
    return belief.argmax(axis=1)


def added(spans: list[tuple[int, int, int]], text: str, places: list[tuple[int, int]], nodes: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans with those of labelled tokens that touch none of them; neighbours of one label are one span.

    An added span holds a digit, or for an e-mail address a digit or an @.
    """
    runs: list[list[int]] = []
    for n, label in zip(nodes.tolist(), labels.tolist()):
        if label and runs and runs[-1][0] == label and runs[-1][2] == n - 1:
            runs[-1][2] = n
        elif label:
            runs.append([label, n, n])
    taken = sorted((s, e) for _, s, e in spans)
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else np.zeros(0)
    new = []
    for label, a, b in runs:
        start, end = places[a][0], places[b][1]
        while end > start and text[end - 1] in ".-%":
            end -= 1
        i = int(np.searchsorted(starts, end)) if taken else 0  # spans that start before the end
        holds = DIGIT_OR_AT if KINDS[label - 1] == "email" else DIGIT
        if end > start and holds.search(text, start, end) and not (i and ends[i - 1] > start):
            new.append((label - 1, start, end))
    return sorted(spans + new)


def scan(docs: DataFrame, weights: crf.Weights | None, keys: Sequence[str | Column] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, spans array<struct<kind, start, end, added>> by kind as listed, then start."""
    source = docs.select(*keys, F.col(text).alias("body__"))
    names = [f.name for f in source.schema.fields[:-1]]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        categories = crf.Categories(category)
        for b in slices(batches, "body__"):
            texts = b.column("body__").to_pylist()
            base = [pattern_spans(t) for t in texts]
            spans = list(base)
            if weights is not None:
                cats, starts = crf.categorised(texts, TOKEN, categories)
                scores = weights.emissions(cats, starts, text_kinds(cats, starts))
                linked = np.isin(cats // SIZES, LINKED_SHAPES)
                may_be = weights.open_tokens(scores, starts, linked)
                for i in np.unique(np.searchsorted(starts, np.flatnonzero(may_be), side="right") - 1).tolist():
                    own = slice(starts[i], starts[i + 1])
                    found = list(TOKEN.finditer(texts[i]))
                    places = [m.span() for m in found]
                    evidence = token_labels(places, base[i])
                    nodes = np.flatnonzero(may_be[own] | (evidence > 0))
                    links = skip_links([m[0] for m in found], np.flatnonzero(linked[own]))
                    given = np.where(evidence[nodes] > 0, evidence[nodes], -1)
                    labels = settled(scores[own], nodes, given, links, weights)
                    free = given < 0
                    spans[i] = added(base[i], texts[i], places, nodes[free], labels[free])
            out = []
            for own, old in zip(spans, base):
                known = set(old)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "added": (k, s, e) not in known} for k, s, e in own])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(span))], names=[*names, "spans"])

    return source.mapInArrow(run, passed_on(source, "spans array<struct<kind:string,start:int,end:int,added:boolean>>"))
