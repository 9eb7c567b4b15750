"""Stages with Python workers pass few documents at once."""

import corpus_pipeline as P

from tabwright.llm.words import BATCH_ROWS

LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_with_python_pass_few_documents_at_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "s", 20) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.conf.get(LIMIT)
    try:
        for name, stage in P.STAGES:
            for before, after in (("10000", str(BATCH_ROWS)), ("0", str(BATCH_ROWS)), ("7", "7")):
                spark.conf.set(LIMIT, before)
                stage(spark, docs, str(tmp_path))
                assert spark.conf.get(LIMIT) == (before if name == "exact_dedup" else after)
                if name in ("toxicity", "near_dedup", "decontamination"):
                    break  # these run jobs at once
    finally:
        spark.conf.set(LIMIT, kept)
