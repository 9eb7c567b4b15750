"""Line de-duplication over levelled sorted runs of line keys.

A line's key is its text without white space at both ends, A-Z lower-cased; what is stored is the key's
128-bit digest.  A run holds one row for each of its keys: the digest, in how many documents it was found
(`n`) and the largest doc_id of those (`keeper`), sorted by digest inside buckets of the digest.

* A batch of documents becomes (key, n, keeper), combined before the shuffle, so a line that a third of
  all documents hold is one row a task.
* `add` merge-anti-joins the batch with each run: a key whose run already says that it is repeated often
  enough and kept by a larger doc_id adds nothing.  What remains becomes a new run of level 0.
* Two runs of a level are merged into one of the next, counts added, so n batches leave at most log2(n)
  runs.  Both steps are merge joins of sorted buckets: batches move once, runs do not.  (Not a union of
  runs with an aggregate: Spark 4.1 takes the union of bucketed scans for bucketed and adds nothing up.)
* `drop_lines` finds the lines to drop by key.  Keys that hold more than a thousandth of all lines, at
  most a thousand, are broadcast and their lines spread over salts.

Keys of at least `shortest` code points found in at least `least` documents lose all their lines except
in the documents with the largest doc_id that holds them.  Documents are rows: rows that share a doc_id
count each, and all that have the largest one keep the line.  A null doc_id is smaller than any.  A null
or empty text is one empty line.  Only doc_id and text are read, so other columns cannot clash.  Rows are
found again by doc_id and digest of the text, never by their place in a scan.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.functions.sizing import new_path, pinned, remove_path

SHORTEST, LEAST = 20, 3
BATCHES = 8
WHITE = " \t\n\x0b\x0c\r"
SMALLEST = -(2**63)
HOT_KEYS, SALTS = 1_000, 1_024


def normalised(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def line_keys(text: Column) -> Column:
    """The key of each line of a text, in order."""
    return F.transform(F.split(normalised(text), "\n"), lambda line: F.btrim(line, F.lit(WHITE)))


def digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, rank, body: what is read of the documents."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(SMALLEST)).alias("rank"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )


def batch_keys(docs: DataFrame, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text", batch: Column | None = None) -> DataFrame:
    """(batch,) key, n, keeper: the distinct keys of a batch, or of several at once; `batch` reads `rank`."""
    rows = rows_of(docs, doc_id, text)
    groups = ["key"] if batch is None else ["batch", "key"]
    rows = rows if batch is None else rows.withColumn("batch", batch)
    lines = rows.select("rank", *groups[:-1], F.explode(F.array_distinct(line_keys(F.col("body")))).alias("line"))
    return lines.where(F.length("line") >= shortest).select("rank", *groups[:-1], digest(F.col("line")).alias("key")).groupBy(*groups).agg(
        F.count("*").alias("n"), F.max("rank").alias("keeper")
    )


class LineRuns:
    """Runs of line keys under the session's shared folder, as bucketed tables of this session."""

    def __init__(self, spark: SparkSession, least: int = LEAST, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []  # the run of each level, if it has one
        self.paths: dict[str, str] = {}

    def dealt(self, keys: DataFrame) -> DataFrame:
        """Rows with a key, one partition for each bucket."""
        return keys.repartition(self.buckets, "key")

    def store(self, dealt: DataFrame, *split_by: str) -> str:
        """Write dealt rows as one sorted file for each bucket; returns the table's name."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "line-run")
        out = dealt.sortWithinPartitions(*split_by, "key").write.format("parquet")
        if split_by:
            out = out.partitionBy(*split_by)
        out.bucketBy(self.buckets, "key").sortBy("key").option("path", self.paths[name]).saveAsTable(name)
        return name

    def forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def unknown(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch that no run settles: a merge-anti-join with each run."""
        for name in self.runs():
            settled = self.spark.table(name).where(F.col("n") >= self.least).select(F.col("key").alias("known"), F.col("keeper").alias("kept_by"))
            keys = keys.join(settled.hint("merge"), (F.col("key") == F.col("known")) & (F.col("kept_by") >= F.col("keeper")), "left_anti")
        return keys

    def add(self, keys: DataFrame, dealt: bool = False) -> None:
        """Add a batch (key, n, keeper) as a run of its own; runs of one level are merged into the next."""
        keys = keys.select("key", "n", "keeper")
        new = self.store(self.unknown(keys if dealt else self.dealt(keys)))
        for level, old in enumerate(self.levels):
            if old is None:
                self.levels[level] = new
                return
            new, self.levels[level] = self.merged(old, new), None
        self.levels.append(new)

    def merged(self, old: str, new: str) -> str:
        """One run of two: a full merge join, bucket by bucket."""
        a, b = (self.spark.table(name).select(*[F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "keeper")]) for name, side in ((old, "a"), (new, "b")))
        both = a.join(b.hint("merge"), F.col("key_a") == F.col("key_b"), "full").select(
            F.coalesce("key_a", "key_b").alias("key"),
            (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"),
            F.greatest("keeper_a", "keeper_b").alias("keeper"),
        )
        run = self.store(both)
        self.forget(old)
        self.forget(new)
        return run

    def repeated(self) -> DataFrame:
        """key, keeper of all keys found in `least` documents or more, written once; all runs become one."""
        names = self.runs()
        while len(names) > 1:
            names[:2] = [self.merged(*names[:2])]
        self.levels = [None] * max(0, len(self.levels) - 1) + names
        if not names:
            return self.spark.createDataFrame([], "key binary, keeper long")
        return pinned(self.spark.table(names[0]).where(F.col("n") >= self.least).select("key", "keeper"))

    def close(self) -> None:
        for name in list(self.paths):
            self.forget(name)
        self.levels = []


def hot_keys(keys: DataFrame, repeated: DataFrame) -> DataFrame:
    """key, keeper of the repeated keys that hold more than 1 / HOT_KEYS of all lines: at most HOT_KEYS rows."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    heavy = keys.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > total / HOT_KEYS).select("key")
    return pinned(repeated.join(heavy, "key", "left_semi"))


def drop_lines(
    docs: DataFrame, repeated: DataFrame, hot: DataFrame, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_lines, n_dropped, text without the dropped lines, for every row of `docs`."""
    rows = rows_of(docs, doc_id, text).withColumn("mark", digest(F.col("body")))
    lines = rows.select("rank", "mark", F.posexplode(line_keys(F.col("body"))).alias("pos", "line")).where(F.length("line") >= shortest)
    lines = lines.select("rank", "mark", "pos", digest(F.col("line")).alias("key"))
    lines = lines.join(F.broadcast(hot.withColumnRenamed("keeper", "hot_keeper")), "key", "left")  # at most HOT_KEYS rows
    salt = F.when(F.col("hot_keeper").isNotNull(), 1 + F.pmod(F.xxhash64("rank", "mark"), F.lit(SALTS))).otherwise(F.lit(0))
    known = repeated.select("key", "keeper", F.lit(0).cast("long").alias("salt"))
    found = lines.withColumn("salt", salt.cast("long")).join(known, ["key", "salt"], "left")
    gone = found.where(F.coalesce("hot_keeper", "keeper") != F.col("rank")).groupBy("rank", "mark").agg(F.collect_set("pos").alias("gone"))
    whole = rows.select("doc_id", "rank", "mark", F.split("body", "\n").alias("lines")).join(gone, ["rank", "mark"], "left")
    lines_kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i)
    )
    return whole.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(lines_kept), "\n").alias("text"),
    )


def dedup_lines(
    docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`drop_lines` of a whole table, taken as `batches` batches of descending doc_ids.

    The texts are read once for the keys of all batches; each batch is then a partition of one stored
    table.  A later batch of documents would be added to the same runs by `LineRuns.add(batch_keys(docs))`.
    """
    spark = docs.sparkSession
    low, high = docs.agg(F.min(F.col(doc_id).cast("long")), F.max(F.col(doc_id).cast("long"))).first()
    if low is None:
        low = high = 0
    width = max(1, -(-(high - low + 1) // batches))
    at = F.least(F.lit(batches - 1), F.floor((F.lit(high) - F.greatest(F.col("rank"), F.lit(low))) / F.lit(width))).cast("int")
    runs = LineRuns(spark, least)
    try:
        keys = spark.table(runs.store(runs.dealt(batch_keys(docs, shortest, doc_id, text, at)), "batch"))
        for batch in range(batches):
            runs.add(keys.where(F.col("batch") == batch), dealt=True)
        repeated = runs.repeated()
        hot = hot_keys(keys, repeated)
    finally:
        runs.close()
    return drop_lines(docs, repeated, hot, shortest, doc_id, text)
