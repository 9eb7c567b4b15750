"""Rows by a 128-bit digest: what repeats is found without moving whole rows.

Rows that are equal for a GROUP BY have equal digests (NULLs equal NULLs, NaN equals NaN, -0.0 equals
0.0).  Only rows whose digest repeats are compared as a whole, so different rows that share a digest stay
apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import col
from .sizing import DRIVER_ROWS, pinned, rows_if_bounded

PARTS = ("__h1", "__h2")


def _plain(field: T.StructField) -> Column:
    c = col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0)).cast(field.dataType)
    return c


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Two 64-bit halves; which cells are NULL is part of both."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    holes = F.concat(F.lit(""), *[F.when(col(f.name).isNull(), "1").otherwise("0") for f in fields])
    values = [_plain(f) for f in fields]
    return [F.xxhash64(F.lit(seed), holes, *values).alias(name) for seed, name in zip((1, 2), PARTS)]


@dataclass
class Repeats:
    """What the digests of a table say."""

    rows: int
    digests: int
    repeated: DataFrame | None  # the repeated digests, None when there are more than may be broadcast
    n_repeated: int


def repeats(df: DataFrame) -> Repeats:
    """Count rows and digests; the shuffle carries digests, combined in each task, and no rows."""
    groups = df.select(*row_digest(df)).groupBy(*PARTS).agg(F.count("*").alias("n"))
    groups = groups.withColumn("more", F.col("n") > 1)
    kept = pinned(groups.groupBy("more", F.when(F.col("more"), F.col(PARTS[0])).alias(PARTS[0]), F.when(F.col("more"), F.col(PARTS[1])).alias(PARTS[1])).agg(
        F.count("*").alias("digests"), F.sum("n").alias("n")
    ))  # one row for all single digests, one for each repeated one
    total = kept.agg(F.sum("n").alias("rows"), F.sum("digests").alias("digests"), F.count_if("more").alias("more")).first()
    found = kept.where("more").select(*PARTS)
    rows = rows_if_bounded(found, DRIVER_ROWS)
    small = None if rows is None else df.sparkSession.createDataFrame(rows, found.schema)
    return Repeats(total["rows"] or 0, total["digests"] or 0, small, total["more"])


def with_repeats(df: DataFrame, known: Repeats) -> DataFrame:
    """The rows whose digest repeats, whole; all rows when repeated digests are too many to broadcast."""
    if known.repeated is None:
        return df
    marked = df.select(*[col(c) for c in df.columns], *row_digest(df))
    return marked.join(F.broadcast(known.repeated), list(PARTS), "left_semi").select(*[col(c) for c in df.columns])  # at most DRIVER_ROWS rows


def distinct_rows(df: DataFrame, known: Repeats) -> int:
    """The number of distinct rows: single digests are rows of their own, the others are compared whole."""
    if known.n_repeated == 0:
        return known.digests
    inside = with_repeats(df, known).groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("__n")).count()
    return inside if known.repeated is None else known.digests - known.n_repeated + inside


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows; rows whose digest is single are not shuffled."""
    known = repeats(df)
    if known.n_repeated == 0:
        return df
    if known.repeated is None:
        return df.dropDuplicates()
    marked = df.select(*[col(c) for c in df.columns], *row_digest(df))
    single = marked.join(F.broadcast(known.repeated), list(PARTS), "left_anti").select(*[col(c) for c in df.columns])  # at most DRIVER_ROWS rows
    return single.unionByName(with_repeats(df, known).dropDuplicates())
