"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays.

Counting.  Each task counts the pairs of neighbouring tokens of its texts and sends them, grouped by their
first word, to buckets: one bucket for all pairs of a first word, so that what interpolation needs of a
context is complete there; pairs of very frequent first words are spread by both words.  (Which words
those are is read from a sample; it decides the route only.)  A bucket adds the counts, writes its pairs as
a sorted array and sends on, for each word, its count, its continuation count (distinct words before it)
and the numbers of its followers seen once, twice and more.  Word buckets add these and write sorted
arrays of words.  Counts cover all training texts; the driver gets one row of totals a bucket.

Scoring.  Workers map the arrays of the shared folder into memory and look up the distinct words and pairs
of a slice of texts at a time by binary search; nothing is loaded whole.  The folder named in
spark.checkpoint.dir therefore has to be mounted on all machines (a file: path).

Tokens: lower-cased words (A-Z only; white space \\x20 \\x09-\\x0D separates them), then one end of text.
A null or empty text is one end.  Unknown words share one extra type.  Words and pairs are told apart by
64-bit hashes.  Columns other than the keys and the text are not read; without training texts every token
has the probability 1 / 1 of the unknown type.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.functions.sizing import new_path

from .words import SPACED, WordHashes, hashed, mixed, passed_on, slices

END, START = b" ", b"\t"  # no word holds white space
TASK_TOKENS = 3_000_000
BUCKET_TOKENS = 2_500_000
HOT_SHARE = 8
SAMPLE = 1 / 64
WORD_COLUMNS = ("count", "before", "once", "twice", "more")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mapped_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all workers can map."""
    parts = urlparse(new_path(spark, label))
    if parts.scheme not in ("", "file"):
        raise ValueError("the arrays are mapped into memory: spark.checkpoint.dir has to be a folder mounted on all machines")
    return parts.path


def stored(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its name at once, so that a repeated task leaves the same file."""
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    with os.fdopen(handle, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def mark(word: bytes) -> int:
    return WordHashes()[word]


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * FACTOR + w)


def buckets_of(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair."""
    route = mixed(u + np.uint64(1))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
        route = np.where(hot[at] == u, pair_keys(u, w), route)
    return (route % np.uint64(buckets)).astype(np.int64)


def word_ranges(buckets: int) -> np.ndarray:
    """The first hash of each word bucket."""
    return (np.arange(buckets, dtype=object) * 2**64 // buckets).astype(np.uint64)


def tokens_of(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens with an end behind each text, starts)."""
    words, starts = hashed(texts, cache, SPACED)
    return np.insert(words, starts[1:], np.uint64(cache[END])), starts + np.arange(len(starts))


def before_each(tokens: np.ndarray, starts: np.ndarray, start_mark: int) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = start_mark
    return before


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


def discounts(n: Sequence[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y)
    return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1))


@dataclass
class Model:
    folder: str
    pair_buckets: int
    word_buckets: int
    hot: np.ndarray
    tokens: int = 0  # N
    types: int = 0  # V
    pairs: int = 0  # distinct
    texts: int = 0
    pair_discounts: tuple = (0.5, 1.0, 1.5)
    word_discounts: tuple = (0.5, 1.0, 1.5)
    word_counts: tuple = (0, 0, 0)  # words with a continuation count of 1, 2, more
    open: dict = field(default_factory=dict, repr=False)

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def found(self, kind: str, keys: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
        """Values of sorted distinct keys, zero where unknown."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.argsort(bucket, kind="stable")
        sorted_buckets = bucket[order]
        edges = np.flatnonzero(np.diff(sorted_buckets, prepend=-1, append=-2)) if len(keys) else []
        for a, b in zip(edges[:-1], edges[1:]):
            rows, name = order[a:b], f"{kind}-{sorted_buckets[a]}"
            known = self.array(f"{name}-keys")
            if known is None or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            hit = known[at] == keys[rows]
            out[rows[hit]] = self.array(f"{name}-values")[at[hit]].reshape(-1, width)
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        return self.found("words", keys, np.searchsorted(word_ranges(self.word_buckets), keys, side="right") - 1, len(WORD_COLUMNS))

    def probabilities(self, before: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each token behind the one before it, training count of each token)."""
        types, place = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        facts = self.words(types)
        here, behind = facts[place[: len(tokens)]], facts[place[len(tokens) :]]
        keys = pair_keys(before, tokens)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        pair = self.found("pairs", distinct, buckets_of(before[first], tokens[first], self.hot, self.pair_buckets), 1)[back, 0]
        base = 1.0 / (self.types + 1)
        if self.pairs:
            off = np.array((0.0, *self.word_discounts))[np.minimum(here[:, 1], 3)]
            left = float(np.dot(self.word_discounts, self.word_counts)) / self.pairs
            base = (here[:, 1] - off) / self.pairs + left * base
        total = behind[:, 2:] @ np.array(self.pair_discounts)
        seen = np.where(before == np.uint64(mark(START)), self.texts, behind[:, 0])
        off = np.array((0.0, *self.pair_discounts))[np.minimum(pair, 3)]
        safe = np.maximum(seen, 1)
        return np.where(seen > 0, (pair - off) / safe + total / safe * base, base), here[:, 0]


def frequent_words(texts: DataFrame, buckets: int) -> np.ndarray:
    """Sorted hashes of words that may hold more than 1 / (HOT_SHARE * buckets) of all tokens, by a sample."""
    words = texts.sample(SAMPLE, seed=7).select(F.explode(F.split(F.lower("body"), r"[\x20\x09-\x0D]+")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = counts.where(F.col("n") * HOT_SHARE * buckets > 2 * total).orderBy(F.desc("n")).limit(HOT_SHARE * buckets).collect()
    return np.sort(np.array([mark(START), *(mark(r["word"].encode()) for r in most)], np.uint64))


def train(texts: DataFrame, text: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """Count all of `texts` and store the model under the shared folder."""
    spark = texts.sparkSession
    source = texts.select(F.col(text).alias("body"))
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, -(-size // (6 * bucket_tokens)))
    model = Model(mapped_folder(spark, "ngrams"), buckets, max(1, -(-buckets // 4)), frequent_words(source, buckets))
    folder, hot, word_buckets = model.folder, model.hot, model.word_buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        start_mark, held, size = cache[START], [], 0

        def counted() -> pa.RecordBatch:
            tokens, before = (np.concatenate(x) for x in zip(*held))
            types, code = np.unique(np.concatenate([tokens, before]), return_inverse=True)
            pair, n = np.unique(code[len(tokens) :] * len(types) + code[: len(tokens)], return_counts=True)
            u, w = types[pair // len(types)], types[pair % len(types)]
            bucket = buckets_of(u, w, hot, buckets)
            order = np.argsort(bucket, kind="stable")
            u, w, n, bucket = u[order], w[order], n[order], bucket[order]
            rows = []
            for b in range(buckets):
                s, e = np.searchsorted(bucket, (b, b + 1))
                if s < e:
                    first = np.flatnonzero(np.concatenate([np.ones(1, bool), u[s + 1 : e] != u[s : e - 1]]))
                    runs = np.diff(first, append=e - s)
                    rows.append((b, u[s:e][first].tobytes(), runs.astype(np.uint32).tobytes(), w[s:e].tobytes(), n[s:e].astype(np.uint32).tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "u", "runs", "w", "n"])

        for b in slices(batches, "body"):
            tokens, starts = tokens_of(b.column("body").to_pylist(), cache)
            held.append((tokens, before_each(tokens, starts, start_mark)))
            size += len(tokens)
            if size >= TASK_TOKENS:
                yield counted()
                size = 0
        if held:
            yield counted()

    def pairs(key: tuple, group: pa.Table) -> pa.Table:
        us, ws, ns = [], [], []
        for r in group.to_pylist():
            us.append(np.repeat(np.frombuffer(r["u"], np.uint64), np.frombuffer(r["runs"], np.uint32)))
            ws.append(np.frombuffer(r["w"], np.uint64))
            ns.append(np.frombuffer(r["n"], np.uint32))
        u, w, n = np.concatenate(us), np.concatenate(ws), np.concatenate(ns).astype(np.int64)
        order = np.lexsort((w, u))
        u, w, n = u[order], w[order], n[order]
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        u, w, n = u[first], w[first], np.add.reduceat(n, first)
        keys = pair_keys(u, w)
        order = np.argsort(keys)
        stored(folder, f"pairs-{key[0].as_py()}-keys", keys[order])
        stored(folder, f"pairs-{key[0].as_py()}-values", n[order].astype(np.uint32 if n.max() < 2**32 else np.uint64))
        zero = np.zeros(len(n), np.int64)
        # As the word before: followers seen once, twice, more.  As the word itself: its count, one more word before it.
        words, facts = summed(
            np.concatenate([u, w]),
            np.concatenate([np.stack([zero, zero, n == 1, n == 2, n > 2], 1), np.stack([n, zero + 1, zero, zero, zero], 1)]),
        )
        edges = [*np.searchsorted(words, word_ranges(word_buckets)), len(words)]
        rows = [(b, words[s:e].tobytes(), packed(facts[s:e])) for b, (s, e) in enumerate(zip(edges, edges[1:])) if s < e]
        rows.append((-1, b"", np.array([[(n == i).sum() for i in (1, 2, 3, 4)] + [len(n)]], np.int64).tobytes()))
        return pa.table([pa.array(c) for c in zip(*rows)], names=["bucket", "words", "facts"])

    def words(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            totals = sum(np.frombuffer(x, np.int64) for x in group.column("facts").to_pylist()).tolist()
        else:
            found, facts = summed(
                np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("words").to_pylist()]),
                np.concatenate([unpacked(x) for x in group.column("facts").to_pylist()]),
            )
            stored(folder, f"words-{bucket}-keys", found)
            stored(folder, f"words-{bucket}-values", facts.astype(np.uint32 if facts.max() < 2**32 else np.uint64))
            before = facts[:, 1]
            texts = facts[found == np.uint64(mark(END)), 0].sum()
            totals = [(before == i).sum() for i in (1, 2, 3, 4)] + [facts[:, 0].sum(), (facts[:, 0] > 0).sum(), (before > 2).sum(), texts]
        return pa.table([pa.array([bucket], pa.int64()), pa.array([[int(x) for x in totals]], pa.list_(pa.int64()))], names=["bucket", "totals"])

    blobs = source.mapInArrow(count, "bucket long, u binary, runs binary, w binary, n binary")
    by_word = blobs.groupBy("bucket").applyInArrow(pairs, "bucket long, words binary, facts binary")
    done = by_word.groupBy("bucket").applyInArrow(words, "bucket long, totals array<long>").collect()  # a row a bucket
    for row in done:
        if row["bucket"] < 0:
            model.pair_discounts, model.pairs = discounts(row["totals"][:4]), row["totals"][4]
    sums = np.sum([r["totals"] for r in done if r["bucket"] >= 0], axis=0)
    if np.ndim(sums):
        model.word_discounts, model.word_counts = discounts(sums[:4]), (int(sums[0]), int(sums[1]), int(sums[6]))
        model.tokens, model.types, model.texts = int(sums[4]), int(sums[5]), int(sums[7])
    return model


def packed(facts: np.ndarray) -> bytes:
    """Five columns, one behind the other, in the narrowest width that holds them (its size in the first byte)."""
    kind = np.uint8 if facts.max(initial=0) < 2**8 else np.uint32 if facts.max() < 2**32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + facts.T.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).reshape(len(WORD_COLUMNS), -1).T.astype(np.int64)


def score(docs: DataFrame, model: Model, keys: Sequence[str | Column] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, n_tokens, n_known, base_score (add-one unigrams), score (both log10) and perplexity."""
    source = docs.select(*keys, F.col(text).alias("body__"))
    names = [f.name for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in slices(batches, "body__"):
            tokens, starts = tokens_of(b.column("body__").to_pylist(), cache)
            p, count = model.probabilities(before_each(tokens, starts, cache[START]), tokens)
            added = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  no text is without a token
            n, total = np.diff(starts), added(np.log10(p))
            base = added(np.log10((count + 1) / (model.tokens + model.types + 1)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *map(pa.array, (n, added((count > 0).astype(np.int64)), base, total, 10 ** (-total / n)))],
                names=[*names, "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    return source.mapInArrow(
        run, passed_on(source, "n_tokens long, n_known long, base_score double, score double, perplexity double")
    )


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """The fold of a row: crc32 of its id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part
