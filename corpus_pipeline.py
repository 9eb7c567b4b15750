"""From raw documents to token ids: five stages, each over all rows that the one before it kept.

A stage takes (spark, docs, sf_dir) and reads its docs from files, so `run` writes each result as Parquet
under the shared folder before the next stage.  All but the last return the rows that stay with all their
columns, whatever those are called.  Stages with Python workers pass few rows at once: a row holds the
whole document next to its text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.functions.sizing import new_path, remove_path
from tabwright.llm import decontamination, exact_dedup, near_dedup, sentencepiece_codec, toxicity
from tabwright.llm.words import small_batches

REJECT_AT = 0.5
NEAR_PERCENT = 80


def whole(docs: DataFrame) -> DataFrame:
    """doc (the whole row) and text."""
    row: Column = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(row.alias("doc"), F.col("text"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the grammar scores as toxic; labels of held-out rows are not learned from."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.learn(docs, labels)
    return toxicity.score(whole(docs), model, ("doc",)).where(F.col("score") < REJECT_AT).select("doc.*")


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs, NEAR_PERCENT)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of words of a benchmark item."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_passages(whole(docs), items, ("doc",)).where("n_hit = 0").select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text they decode to."""
    small_batches(spark)
    coded = sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", keep_civil),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("decontamination", keep_uncontaminated),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # the first stage is learned; tests/llm holds the whole against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
