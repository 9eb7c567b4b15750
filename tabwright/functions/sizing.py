"""Keeping work spread out: bounded driver reads, skew-safe lookups, total order.

* `rows_if_bounded` is the only way fitted rows reach the driver; it refuses
  to read more than its limit.
* `lookup` broadcasts a parameter table only after that check; otherwise it
  shuffles, with the heaviest keys taken out of the shuffle.
* `numbered` gives a table-wide row number without a one-task window: range
  partitions, one count per partition, then offsets.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from .columns import col

DRIVER_ROWS = 20_000
DRIVER_CHARS = 8_000_000
HOT_KEYS = 1_000
SALTS = 1_024
TASK_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    existing = configured or sc.getCheckpointDir()
    if existing is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        existing = tempfile.mkdtemp(prefix="tabwright-")
        sc.setCheckpointDir(existing)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(existing)
    return existing


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what `new_path` led to, in whatever store the shared folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def pinned(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage so that every reader sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_if_bounded(df: DataFrame, limit: int = DRIVER_ROWS) -> list[Row] | None:
    """All rows when there are at most `limit`, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def lookup(
    df: DataFrame,
    params: DataFrame,
    key: str,
    weight: str | None = None,
    limit: int = DRIVER_ROWS,
) -> DataFrame:
    """Left join to a parameter table that has one row per `key`.

    Small tables (checked) are broadcast.  Larger ones are joined by shuffle;
    keys holding more than 1/HOT_KEYS of all rows by `weight` - at most
    HOT_KEYS of them - are answered by broadcast and spread over salts, so no
    shuffle partition receives a heavy key.  What is broadcast is read from the
    stored table: rows handed over by the driver would start Python workers.
    """
    values = [c for c in params.columns if c not in (key, weight)]
    params = pinned(params.select(key, *values, *([weight] if weight else [])))  # read up to four times below
    rows = rows_if_bounded(params.select(key, *values), limit)
    if rows is not None and sum(len(str(v)) for r in rows for v in r) <= DRIVER_CHARS:
        return df.join(F.broadcast(params.select(key, *values)), key, "left")
    cold = params.select(key, *[F.col(v).alias(f"__cold_{v}") for v in values]).withColumn("__salt", F.lit(0))
    if weight is None:
        apart = F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        joined = df.withColumn("__salt", F.when(col(key).isNull(), apart).otherwise(F.lit(0))).join(cold, [key, "__salt"], "left")
        return joined.select(*[col(c) for c in df.columns], *[F.col(f"__cold_{v}").alias(v) for v in values])
    total = params.agg(F.sum(weight)).first()[0] or 0
    heavy = params.where(F.col(weight) > F.lit(total / HOT_KEYS))
    hot = heavy.select(
        key, F.lit(True).alias("__hit"), *[F.col(v).alias(f"__hot_{v}") for v in values]
    )
    step = df.join(F.broadcast(hot), key, "left")
    step = step.withColumn(
        "__salt",
        F.when(
            F.col("__hit") | col(key).isNull(),
            F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"),
        ).otherwise(F.lit(0)),
    )
    joined = step.join(cold, [key, "__salt"], "left")
    return joined.select(
        *[col(c) for c in df.columns],
        *[
            F.when(F.col("__hit"), F.col(f"__hot_{v}")).otherwise(F.col(f"__cold_{v}")).alias(v)
            for v in values
        ],
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a freshly read table that came as fewer splits than cores to all cores.

    For row-heavy work over few unsplittable files; a table in many splits is
    returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def parted(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """`df` of `rows` rows hashed by `keys`, as many tasks as they need: a hash table by these keys, of a task, is bounded.

    Behind it aggregates by `keys` and more need no shuffle.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(parts, *[col(k) for k in keys])


def slotted(df: DataFrame, order: Sequence[Column | str], slot: str = "__slot", slots: int | None = None) -> DataFrame:
    """Split `df` into contiguous ranges of `order`; `slot` numbers the ranges.

    As many ranges as the input has splits (those are sized by bytes), or as shuffles have partitions if
    that is more.  The split depends on sampling, so it is pinned before anyone reads it.
    """
    parts = slots or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    return pinned(df.repartitionByRange(parts, *order).withColumn(slot, F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add a 0-based row number over the whole table in `order`."""
    ranged = slotted(df, order)
    sizes = ranged.groupBy("__slot").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__slot", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__slot").orderBy(*order)
    return (
        ranged.join(F.broadcast(starts), "__slot")  # one row per shuffle partition
        .withColumn(name, F.col("__start") + F.row_number().over(within) - 1)
        .drop("__slot", "__start")
    )
