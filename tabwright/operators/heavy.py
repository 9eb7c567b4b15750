"""The k most frequent values, exactly, without a count of every value.

Rows are first counted by a hash of their value: a table of bounded size, in which a bucket's count is an upper
bound for each value in it.  The values of the heaviest buckets are then counted one by one; the k-th largest of
those counts is a lower bound for the k-th largest of all.  A value of a bucket below it cannot be among the k,
so only buckets that reach it and are not counted yet are left, and are counted too.  Nothing is estimated: the
sizes decide how much is counted, never the result.  The rows are read twice, three times when buckets are left;
where all values are about equally frequent no bucket can be excluded and all of them are counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col
from ..functions.sizing import pinned
from .frequencies import CELL, cells, is_value

BUCKETS = 65_536
FIRST_BUCKETS = 256


def heavy_values(
    rows: DataFrame, value: Sequence[str], k: int, group: Sequence[str] = (), weight: Column | None = None,
    also: Mapping[str, Column] | None = None, buckets: int = BUCKETS, first: int = FIRST_BUCKETS,
) -> DataFrame:
    """(group, value, n, also): the k values of largest n in each group, more where the k-th n is tied.

    n is the sum of `weight` (1 a row), which must not be negative; values without weight are left out.  `also`
    adds further aggregates over all rows of a value.  The groups have to be few: up to `buckets` rows are kept
    for each.  NULL is a value like others.
    """
    amount = F.sum(weight if weight is not None else F.lit(1).cast("bigint")).alias("n")
    keys = [F.lit(0).alias("__all"), *[col(g) for g in group]]
    names = ["__all", *group]
    extras = [c.alias(n) for n, c in (also or {}).items()]
    placed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*[col(v) for v in value]), F.lit(buckets)))
    sums = pinned((placed if weight is None else placed.where(weight > 0)).groupBy(*keys, "__bucket").agg(amount).where("n > 0"))

    def counted(chosen: DataFrame) -> DataFrame:
        """Exact counts of all values in the chosen buckets."""
        keep = chosen.select(*[col(g).alias(f"__g{i}") for i, g in enumerate(group)], col("__bucket").alias("__b"))
        same = F.col("__bucket") == F.col("__b")
        for i, g in enumerate(group):
            same = same & col(g).eqNullSafe(F.col(f"__g{i}"))
        found = placed.join(F.broadcast(keep), same, "left_semi")  # at most `buckets` rows of two numbers a group
        return found.groupBy(*keys, *[col(v) for v in value]).agg(amount, *extras).where("n > 0")

    heaviest = Window.partitionBy(*names).orderBy(F.desc("n"), "__bucket")
    ranked = sums.withColumn("__rank", F.row_number().over(heaviest))
    known = pinned(counted(ranked.where(F.col("__rank") <= first)))
    in_order = Window.partitionBy(*names).orderBy(F.desc("n"))
    # Spark keeps k rows a task below a window that is cut by its rank, so no task gets all values of a group.
    floors = known.select(*names, "n", F.row_number().over(in_order).alias("__rank")).where(F.col("__rank") <= k)
    floors = floors.groupBy(*[col(c).alias(f"__f{i}") for i, c in enumerate(names)]).agg(
        F.min("n").alias("__floor"), F.max("__rank").alias("__found")
    ).where(F.col("__found") == k)
    match = F.lit(True)
    for i, c in enumerate(names):
        match = match & col(c).eqNullSafe(F.col(f"__f{i}"))
    open_buckets = ranked.where(F.col("__rank") > first).join(F.broadcast(floors), match, "left")  # one row a group
    left = pinned(open_buckets.where(F.col("n") >= F.coalesce("__floor", F.lit(0))))
    if not left.isEmpty():
        known = known.unionByName(counted(left))
    best = known.withColumn("__place", F.rank().over(in_order)).where(F.col("__place") <= k)
    return best.drop("__all", "__place")


def column_modes(df: DataFrame, columns: Sequence[str] | None = None, **sizes) -> DataFrame:
    """(column_name, l, d, s, n): the most frequent value of each column; ties take the smallest.

    As `frequencies.modes` of a full frequency table, for columns of many values.
    """
    best = heavy_values(cells(df, columns).where(is_value()), CELL, 1, ["column_name"], **sizes)
    least = F.min(F.struct(*CELL)).alias("best")
    return best.groupBy("column_name").agg(least, F.max("n").alias("n")).select(
        "column_name", *[F.col(f"best.{c}").alias(c) for c in CELL], "n"
    )
