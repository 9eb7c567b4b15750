"""Sharding, exact de-duplication, chat formatting, SentencePiece: against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabwright.llm import chat, exact_dedup, sentencepiece_codec as codec, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation_is_one_to_one_and_invertible(n):
    rows = np.arange(n)
    places = sharding.permuted(rows, n, seed=5)
    assert sorted(places.tolist()) == rows.tolist()
    assert (sharding.permuted(places, n, seed=5, inverse=True) == rows).all()
    assert n < 10 or (sharding.permuted(rows, n, seed=6) != places).any()


def test_shards(odd, none):
    given = odd.select("doc_id", "text").collect()
    got = sharding.shard(odd, 3, seed=1).collect()
    sized = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, *sized(t)) for i, t in given)
    for s in range(3):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    counts = Counter(r["shard"] for r in got).values()
    assert max(counts) - min(counts) <= 1
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
    places = sharding.permuted(np.arange(len(order)), len(order), 1).tolist()
    assert Counter((r.doc_id, r["size"], r.place) for r in got) == Counter((r.doc_id, r["size"], p) for r, p in zip(order, places))
    assert sharding.shard(none, 3).count() == 0


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda body: F.substring(F.sha2(body, 256), 1, 1)])
def test_equal_texts(odd, none, digest):
    """The weak digest is shared by different texts, which must stay apart."""
    got = exact_dedup.exact_groups(odd, digest=digest, salts=3).collect()
    groups: dict[str, list] = {}
    for i, t in odd.select("doc_id", "text").collect():
        groups.setdefault(lowered(t), []).append(i)
    want = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        want.update((i, max(known, default=None), len(ids)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_groups(none).count() == 0


def test_drop_copies_keeps_whole_rows(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and exact_dedup.drop_copies(none).count() == 0
    assert Counter(lowered(r.text) for r in kept.collect()) == Counter({lowered(r.text) for r in odd.collect()})


TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a<|end|>b\\"), (1, 2, "assistant", None), (1, 2, "assistant", "\\<\\[["),
    (2, None, None, None), (2, 1, "we<|body|>ird\n", "x"), (3, 5, "assistant", "<|loss|><|more|>"), (3, 5, "assistant", "<|loss|><|more|>"),
    (None, 1, "user", "u"), (None, 0, "system", "日本"), (4, 0, "user", "<\\"),
]


def test_chats_read_back(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)).withColumn("blocks", F.lit(2))
    read = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in read[conv].turns] == [(r or "", t or "") for _, _, r, t in own]
        assert read[conv].loss_texts == [t or "" for _, _, r, t in own if r == "assistant"]
        marks = read[conv].formatted
        assert "</s>" not in marks and "[INST]" not in marks and "[/INST]" not in marks
    assert chat.format_chats(turns.where("1 = 0")).count() == 0


def test_adjacent_turns_of_a_role_are_one_block(spark):
    turns = spark.createDataFrame([(1, i, "user" if i < 3 else "assistant", str(i)) for i in range(5)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns).first().formatted == "<|start|>user<|body|>0<|more|>1<|more|>2<|end|><|start|>assistant<|loss|>3<|more|>4<|end|>"


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_are_the_library_s(odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = codec.encode_decode(odd, PIECES, ("doc_id", "lang"))
    assert got.columns == ["doc_id", "lang", "ids", "decoded"] and codec.encode_decode(none, PIECES).count() == 0
    want = Counter((r.doc_id, tuple(ids := model.encode(r.text or "")), model.decode(ids)) for r in odd.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == want


def test_word_table_by_chance():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert codec.words_are_independent(model)
    table, pick = codec.WordTable(model), random.Random(3)
    parts = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "日", "😀", "x y", "<s>", "\\", ".", "ß", "\x00", "　"]
    for _ in range(300):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 12)))
        assert table.encode([text, None])[0].tolist() == model.encode(text)


