"""Words of whole texts as hash arrays: the shared small helper of the text operators.

A text is taken as UTF-8 bytes, lower-cased in A-Z only, cut into words, and each word becomes a 64-bit
hash.  A batch of texts is one flat array with a start for each text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, types as T

SLICE_BYTES = 2 << 20
BATCH_ROWS = 1_000
CACHED_WORDS = 150_000

# White space \x20 \x09-\x0D separates words; A-Z is lower-cased.
SPACED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Everything of ASCII but 0-9, A-Z and a-z separates words.
ALPHANUMERIC = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it is full, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None, table: bytes = SPACED) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


def hashed(texts: list[str | None], cache: WordHashes, table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, start of each text and the end)."""
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    look = cache.__getitem__
    for i, text in enumerate(texts):
        words = words_of(text, table)
        starts[i + 1] = starts[i] + len(words)
        if words:
            parts.append(np.fromiter(map(look, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near values become unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; n-1 fewer than there are words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    factor, total = np.uint64(0x9E3779B97F4A7C15), np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * factor + hashes[i : len(hashes) - n + 1 + i]
    return mixed(total)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session pass at most `rows` rows at once to Python; a limit that is lower already stays.

    Batches are counted in rows, and rows of several whole texts fill buffers of the JVM and of the worker,
    which both keep what they once had.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed; workers are used again."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` bytes of text (one row at least)."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def passed_on(source: DataFrame, more: str) -> T.StructType:
    """The columns of `source` but its last (the text), then those that `more` declares."""
    return T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(more).fields])
