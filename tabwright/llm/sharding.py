"""Shards by a keyed permutation of global row numbers.

Rows get a global number by sorting on (doc_id, text checksum, size), a Feistel network with cycle
walking permutes 0..N-1, and a row's place p is shard p mod S, slot p div S.  Anyone who knows N, S and
the seed can compute a row's place, or the row number behind a place, without reading data.

Counts of shards differ by one row at most and slots have no gaps (law `rows`).  Rows that agree in all
three sort keys are interchangeable; a null doc_id sorts first, a null text counts as empty.  Only the
key columns are sorted, never texts, and repeated rows are spread over tasks by their scan position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.sizing import pinned

ROUNDS = 6
MASK = 0xFFFFFFFF


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 32-bit key a round, from the seed."""
    return [(seed * 0x9E3779B1 + (i + 1) * 0x85EBCA77) & MASK for i in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of each half, so that both halves together number at least n values."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, bits: int, keys: list[int], inverse: bool = False) -> np.ndarray:
    """A bijection of 0 .. 4**bits - 1."""
    low = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & low

    def scrambled(half: np.ndarray, key: int) -> np.ndarray:
        y = (half + np.uint64(key)) & np.uint64(MASK)
        for _ in range(2):
            y = ((y ^ (y >> np.uint64(16))) * np.uint64(0x45D9F3B)) & np.uint64(MASK)
        return (y ^ (y >> np.uint64(16))) & low

    for key in reversed(keys) if inverse else keys:
        left, right = (right ^ scrambled(left, key), left) if inverse else (right, left ^ scrambled(right, key))
    return (left << np.uint64(bits)) | right


def permuted(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The place of each row number below n (inverse: the row number of each place): walk until below n."""
    bits, keys, x = half_bits(n), round_keys(seed), rows.astype(np.uint64)
    x = feistel(x, bits, keys, inverse)
    while (out := x >= np.uint64(n)).any():
        x[out] = feistel(x[out], bits, keys, inverse)
    return x.astype(np.int64)


def numbered_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(doc_id, size, text_crc32, seat in the order of the three; the number of rows before each range of seats).

    A row's global number is the rows before its range and its position in the range.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        rows.withColumn("at", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(parts, *order, "at")
        .sortWithinPartitions(*order)
        .drop("at")
        .withColumn("seat", F.monotonically_increasing_id())  # range number, then position in the range
    )
    kept = pinned(ranged)  # the ranges depend on a sample
    sizes = {
        r["part"]: r["n"]
        for r in kept.groupBy(F.shiftright("seat", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    }  # one number for each range
    starts = np.zeros(parts + 1, np.int64)
    for part, n in sizes.items():
        starts[part + 1] = n
    return kept, np.cumsum(starts)


def shard(docs: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, place, shard, slot for every row of `docs`."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    seated, starts = numbered_rows(docs, doc_id, text)
    kind = seated.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seat = b.column("seat").to_numpy()
            rows = starts[seat >> 33] + (seat & ((1 << 33) - 1))
            columns = [*b.columns[:3], pa.array(rows), pa.array(permuted(rows, int(starts[-1]), seed))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "text_crc32", "row", "place"])

    placed = seated.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, row long, place long")
    return placed.withColumns({
        "shard": F.pmod("place", F.lit(shards)).cast("int"),
        "slot": F.expr(f"place div {shards}"),
    })
