"""Exact de-duplication in three combining steps that no group of copies can overload.

1. Locally: each task combines equal texts of its own rows (the map side of the first aggregate).
2. By salt: what the tasks found meets in (digest, salt) groups, so a text held by a third of all rows
   arrives as one row a task, split over `salts` groups.
3. Globally: the at most `salts` winners of a text are combined.

All three group by digest and whole text, so texts that share a digest stay apart.  Documents then find
their group by digest alone; those of the digests that several texts share are told apart by the text.

Texts are equal when identical after lower-casing A-Z; a null text is empty.  Of equal texts the row with
the largest doc_id stays (null is smaller than any; of rows with the same doc_id and text exactly one
stays).  Very long texts are compared whole; an empty table gives no rows.  Only doc_id and text are
read, so other columns cannot clash.  Rows are known by doc_id and digest, and rows that agree in both are
numbered in a stored table, so no result depends on how two scans of the input are split.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.sizing import lookup, pinned

from .scratch import whole_row

SALTS = 16
SMALLEST = -(2**63)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def ranked(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(SMALLEST))


def winners(members: DataFrame, *keys: str) -> DataFrame:
    """keys, keep: (rank, id) of the row that stays in each group."""
    return members.groupBy(*keys).agg(F.max(F.struct("rank", "id")).alias("keep"))


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, salts: int = SALTS
) -> DataFrame:
    """doc_id, rank, digest, keep_id, group_size, kept: a row for every row of `docs`; rank is doc_id, the least long for null."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), ranked(doc_id).alias("rank"), normalised(F.col(text)).alias("body")
    ).withColumn("digest", digest(F.col("body")))

    def combined(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"))

    # The salt is the task's; which one it is decides only where texts meet.
    each = rows.select("digest", "body", F.pmod(F.hash(F.spark_partition_id()), F.lit(salts)).alias("salt"), F.lit(1).cast("long").alias("n"))
    groups = combined(combined(each, "digest", "salt", "body"), "digest", "body")
    by_digest = pinned(groups.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("n").alias("n")))
    members = pinned(rows.select("doc_id", "rank", "digest", F.monotonically_increasing_id().alias("id")))
    shared = by_digest.where("texts > 1").select("digest")

    def placed(found: DataFrame) -> DataFrame:
        return found.select(
            "doc_id", "rank", "digest", F.when(F.col("keep.rank") > SMALLEST, F.col("keep.rank")).alias("keep_id"),
            F.col("n").alias("group_size"), (F.col("id") == F.col("keep.id")).alias("kept"),
        )

    single = by_digest.where("texts = 1").join(winners(members, "digest"), "digest").select("digest", "keep", "n", F.col("n").alias("weight"))
    found = placed(lookup(members, single, "digest", weight="weight").where("keep IS NOT NULL"))
    if shared.isEmpty():
        return found
    late = pinned(rows.join(shared, "digest", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    each_text = winners(late, "digest", "body").join(late.groupBy("digest", "body").agg(F.count("*").alias("n")), ["digest", "body"])
    return found.unionByName(placed(late.join(each_text, ["digest", "body"])))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    known = ["rank", "digest"]
    groups = exact_groups(docs, doc_id, text).select(*known, "keep_id", "kept")
    # A row that stays may have twins with the same doc_id and text: of those any one stays.
    stays = F.col("rank") == F.coalesce("keep_id", F.lit(SMALLEST))
    whole = docs.select(ranked(doc_id).alias("rank"), sha256(normalised(F.col(text))).alias("digest"), whole_row(docs).alias("doc"))
    rest = whole.join(groups.where(~stays).select(*known).distinct(), known, "left_anti")
    twins = pinned(groups.where(stays & ~F.col("kept")).select(*known).distinct())
    if not twins.isEmpty():
        rest = rest.join(twins, known, "left_anti").unionByName(rest.join(twins, known, "left_semi").dropDuplicates(known))
    return rest.select("doc.*")
