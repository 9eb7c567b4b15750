"""The five stages against plain Python; odd rows; the registered names."""

import random

import __spark_entry__ as entry
import corpus_pipeline as P
import public_tokenizers
import sentencepiece

from tabwright.llm.words import words_of


def tables(spark, tmp_path, docs, labels, items):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    pick = random.Random(1)
    prose = lambda n: " ".join(pick.choice(WORDS) for _ in range(n))
    WORDS = [f"w{i}" for i in range(3000)]
    clean = [prose(60) for _ in range(60)]
    toxic = [f"{prose(20)}. You are a {pick.choice(['moron', 'idiot'])} and a loser. {prose(20)}" for _ in range(40)]
    item = prose(30)
    near = clean[0].replace(clean[0].split()[30], "other")
    leak = prose(20) + " " + " ".join(item.split()[5:17]) + " " + prose(20)
    texts = clean + toxic + [clean[1].upper(), near, leak, clean[2], "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    labels = [(i, 1, int(60 <= i < 100)) for i in range(90)]
    folder = tables(spark, tmp_path, docs, labels, [(1, item), (2, None)])
    got = {r.doc_id: r for r in P.run(spark, folder).collect()}
    n = len(clean) + len(toxic)
    gone = set(range(60, 100)) | {1, 2, n + 2} | {n + 4, n + 1}  # toxic; copies with a smaller id; the leak; one of two empty texts; the near copy
    assert set(range(n + 6)) - set(got) == gone
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in got.items():
        assert r.ids == model.encode(texts[i] or "") and r.n_tokens == len(r.ids) and r.decoded == (texts[i] or "")
    assert words_of(near) != words_of(clean[0])


def test_each_stage_takes_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd")
    folder = tables(spark, tmp_path, none, [], [])
    for name, stage in P.STAGES:
        for docs, empty in ((spark.read.parquet(f"{tmp_path}/odd"), False), (spark.read.parquet(f"{folder}/documents.parquet"), True)):
            out = stage(spark, docs, folder)
            assert name == "sentencepiece" or out.columns == odd.columns
            assert (out.count() == 0) == empty


def test_names():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
