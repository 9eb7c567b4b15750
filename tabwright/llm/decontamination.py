"""Benchmark passages in documents, found by winnowing.

Words are taken from whole texts.  Of both documents and benchmark items the hashes of all k-grams are
winnowed: of every `window - k + 1` neighbouring k-grams the one with the smallest hash is kept (all of
them at a tie).  Whatever `window` words two texts share, they share all its k-grams and so the kept one.
Each kept k-gram, the print, is extended to the full windows around it; a document window is hit if an
item has the same print with the same window around it, so Spark joins both sides on (print, window).
Items of fewer than `window` words are one window of their own length, whose print is the whole.

Items are read by Spark alone.  Equal items are one class until the end; their ids are joined to the
documents that hit the class.  The table of prints is written once.  What documents get of it is a bit
table of its prints, at most `MOST_BITS` bits whatever the size of the benchmark: prints that it excludes
never leave their task, the others are joined.  A table of at most `small_rows` rows (counted) is
broadcast, a larger one is joined by shuffle, with heavy keys of the document side spread over salts.
Documents are read once and written with what they may have hit; rows without any such print go to the
result without a shuffle.  These stored rows and those found stay in the shared folder for the result.

Null and empty texts have no words and no hits, items without words never occur, equal items all count,
a null item_id is the empty string.  Repeated rows and ties are rows of their own, numbered in the stored
table; empty tables give no rows and no hits; columns other than the keys and the text are not read, and
keys may have any names but those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .words import ALPHANUMERIC, WordHashes, grams, hashed, mixed, passed_on, slices

WINDOW, GRAM = 10, 5
SMALL_ROWS = 500_000
HOT_SHARE = 1_000
SALTS = 256
CHUNKS = 64
MOST_BITS = 1 << 27
BITS_PER_PRINT = 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PLACES = "struct<print:bigint,span:bigint,first:int,length:int>"
SPANS = "array<struct<first:int,end:int>>"


def winnowed(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Positions of the kept k-grams; `ends` is the end of its text for every word."""
    width = window - gram + 1
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    values = grams(hashes, gram)
    n = len(hashes) - window + 1
    whole = np.arange(n) + window <= ends[:n]
    least = values[:n].copy()
    for i in range(1, width):
        np.minimum(least, values[i : i + n], out=least)
    kept = np.zeros(len(values), bool)
    for i in range(width):
        kept[i : i + n] |= whole & (values[i : i + n] == least)
    return np.flatnonzero(kept)


def places(
    words: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, window: int, gram: int, bits: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(print, hash of a window of `length` words around it, first word of that window), in order of the first word.

    start, end: of the text of each word.  `bits` excludes prints that no item has.
    """
    if length == window:
        at, size = winnowed(words, end, window, gram), gram
    else:
        n = max(len(words) - length + 1, 0)
        at, size = np.flatnonzero(np.arange(n) + length <= end[:n]), length
    found = mixed(grams(words, size)[at] + np.uint64(length) * FACTOR)
    if bits is not None:
        place = found >> np.uint64(65 - len(bits).bit_length() - 3)
        ok = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        at, found = at[ok], found[ok]
    back = np.arange(length - size + 1)
    first = (at[:, None] - back).ravel()
    owner = np.repeat(at, len(back))
    whole = (first >= start[owner]) & (first + length <= end[owner]) if len(at) else np.zeros(0, bool)
    first, found = first[whole], np.repeat(found, len(back))[whole]
    span = np.full(len(first), length, np.uint64)
    for i in range(length):
        span = span * FACTOR + words[first + i]
    order = np.argsort(first, kind="stable")
    return found[order], mixed(span)[order], first[order]


def edges_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the text of each word."""
    sizes = np.diff(starts)
    return np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)


def item_prints(items: DataFrame, window: int, gram: int) -> DataFrame:
    """print, span, length, class (digest of the words) of each window; items: body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in slices(batches, "body"):
            words, starts = hashed(b.column("body").to_pylist(), cache, ALPHANUMERIC)
            start, end = edges_of(starts)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if s < e:
                    length = min(e - s, window)
                    found, span, _ = places(words[s:e], start[s:e] - s, end[s:e] - s, length, window, gram)
                    rows = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array(span.view(np.int64)), pa.array(np.full(rows, length, np.int32)), pa.array([class_of(words[s:e])] * rows, pa.binary())],
                        names=["print", "span", "length", "class"],
                    )

    return items.select("body").mapInArrow(run, "print long, span long, length int, class binary").distinct()


def item_classes(items: DataFrame) -> DataFrame:
    """class, item of all items with words; items: item, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in slices(batches, "body"):
            words, starts = hashed(b.column("body").to_pylist(), cache, ALPHANUMERIC)
            classes = [class_of(words[s:e]) if s < e else None for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(classes, pa.binary())], names=["item", "class"])

    return items.select("item", "body").mapInArrow(run, "item string, class binary").where("class IS NOT NULL").distinct()


def class_of(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def bit_table(prints: DataFrame, rows: int) -> np.ndarray:
    """Bits at the leading bits of every print, in bytes: a table of bounded size, built in parts by Spark."""
    size = 1 << 16
    while size < min(rows * BITS_PER_PRINT, MOST_BITS):
        size *= 2
    part, shift = size // CHUNKS, 64 - size.bit_length() + 1

    def run(key: tuple, group: pa.Table) -> pa.Table:
        own = np.zeros(part, np.uint8)
        own[((group.column("print").to_numpy().view(np.uint64) >> np.uint64(shift)) % np.uint64(part)).astype(np.int64)] = 1
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    chunk = F.shiftrightunsigned("print", 64 - CHUNKS.bit_length() + 1).alias("chunk")
    out = np.zeros(size // 8, np.uint8)
    for r in prints.select("print").distinct().select(chunk, "print").groupBy("chunk").applyInArrow(run, "chunk long, bits binary").collect():
        out[r["chunk"] * part // 8 : (r["chunk"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], small: bool, salt_by: Sequence[str]) -> DataFrame:
    """Inner join; broadcast if `small`, else by shuffle with the heavy keys of `left` spread over salts."""
    if small:
        return left.join(F.broadcast(right), [*on])
    counts = left.groupBy(*on).agg(F.count("*").alias("n__"))
    total = counts.agg(F.sum("n__")).first()[0] or 0
    heavy = counts.where(F.col("n__") * HOT_SHARE > total).select(*on, F.lit(True).alias("heavy__"))  # fewer than HOT_SHARE keys
    salt = F.when(F.col("heavy__"), F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("heavy__"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = left.join(F.broadcast(heavy), [*on], "left").withColumn("salt__", salt).drop("heavy__")
    copied = right.join(F.broadcast(heavy), [*on], "left").withColumn("salt__", F.explode(salts)).drop("heavy__")
    return spread.join(copied, [*on, "salt__"]).drop("salt__")


def document_places(docs: DataFrame, lengths: Sequence[int], bits: np.ndarray, window: int, gram: int) -> DataFrame:
    """The columns of `docs` with its last one, the text, replaced by n_words and met: windows around prints that `bits` has."""
    shared, names = docs.sparkSession.sparkContext.broadcast((list(lengths), bits)), docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (lengths, bits), cache = shared.value, WordHashes()
        for b in slices(batches, docs_text):
            words, starts = hashed(b.column(docs_text).to_pylist(), cache, ALPHANUMERIC)
            start, end = edges_of(starts)
            parts = [(*places(words, start, end, n, window, gram, bits), n) for n in lengths]
            prints, spans, firsts = (np.concatenate([np.zeros(0, t), *[p[i] for p in parts]]) for i, t in enumerate((np.uint64, np.uint64, np.int64)))
            length = np.concatenate([np.zeros(0, np.int32), *[np.full(len(p[0]), p[3], np.int32) for p in parts]])
            owner = np.searchsorted(starts, firsts, side="right") - 1  # texts without words begin where the next one does
            order = np.argsort(owner, kind="stable")
            fields = prints[order].view(np.int64), spans[order].view(np.int64), (firsts - starts[owner])[order].astype(np.int32), length[order]
            offsets = np.searchsorted(owner[order], np.arange(len(starts))).astype(np.int32)
            met = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(map(pa.array, fields)), names=["print", "span", "first", "length"]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(starts)), met], names=[*names, "n_words", "met"])

    docs_text = docs.columns[-1]
    return docs.mapInArrow(run, passed_on(docs, f"n_words long, met array<{PLACES}>"))


def find_passages(
    docs: DataFrame, items: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM, small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """The key columns, n_words, n_hit, item_ids (sorted strings) and spans (first and end of each run of hit words)."""
    if not 0 < gram <= window:
        raise ValueError("it takes 0 < gram <= window")
    scratch = Scratch(docs.sparkSession)
    known = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("body"))
    prints = scratch.keep("item-prints", item_prints(known, window, gram))
    classes = scratch.keep("item-classes", item_classes(known))
    rows, lengths = prints.count(), [r["length"] for r in prints.select("length").distinct().collect()]  # at most `window`
    few = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("size")).first()

    source = docs.select(F.struct(*[F.col(k) for k in keys]).alias("keys"), F.col(text).alias("body"))
    stored = scratch.keep(
        "met", document_places(source, sorted(lengths), bit_table(prints, rows), window, gram).withColumn("row", F.monotonically_increasing_id())
    )
    places_met = stored.where(F.size("met") > 0).select("row", F.inline("met"))
    pairs = matched(places_met, prints.drop("length"), ("print", "span"), rows <= small_rows, ("row", "first"))
    hits = scratch.keep("hits", pairs.select("row", "first", (F.col("first") + F.col("length")).alias("end"), "class").distinct())

    order = Window.partitionBy("row").orderBy("first", "end")  # the windows of one document
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = hits.select("row", "first", "end").distinct().withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("new").over(order)).groupBy("row", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    small = few["n"] <= small_rows and few["size"] <= 64 * small_rows
    named = matched(hits.select("row", "class").distinct(), classes, ("class",), small, ("row",))
    ids = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    found = scratch.keep("found", spans.join(ids, "row"))
    scratch.drop("item-prints", "item-classes", "hits")

    nothing = F.array().cast(SPANS), F.array().cast("array<string>")
    without = stored.where(F.size("met") == 0).select("keys", "n_words", nothing[0].alias("spans"), nothing[1].alias("item_ids"))
    some = stored.where(F.size("met") > 0).select("row", "keys", "n_words").join(found, "row", "left").select(
        "keys", "n_words", F.coalesce("spans", nothing[0]).alias("spans"), F.coalesce("item_ids", nothing[1]).alias("item_ids")
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return without.unionByName(some).select("keys.*", "n_words", n_hit.alias("n_hit"), "item_ids", "spans")
