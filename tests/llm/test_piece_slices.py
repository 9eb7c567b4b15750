"""Texts reach the segmenting library in small pieces, whatever the batch."""

import pyarrow as pa
import public_tokenizers

from tabwright.llm import sentencepiece_codec as S


def test_ids_of_few_texts_are_held_at_once(spark):
    seen = []

    class Docs:
        """What encode_decode asks of a table, run here on one batch."""

        def select(self, *columns):
            return self

        @property
        def schema(self):
            return spark.createDataFrame([], "doc_id long, body__ string").schema

        def mapInArrow(self, run, schema):
            texts = [f"word{i} " * 1_000 for i in range(200)]
            batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["doc_id", "body__"])
            for out in run(iter([batch])):
                seen.append(sum(map(len, out.column("decoded").to_pylist())))
            return sum(seen) == sum(map(len, texts))

    assert S.encode_decode(Docs(), public_tokenizers.path("piece_bpe_32k.model"))
    assert max(seen) <= (256 << 10) + 10_000
