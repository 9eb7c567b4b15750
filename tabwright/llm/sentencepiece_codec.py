"""SentencePiece ids through a table of distinct marked words.

A text is marked as the library does: one marker before it, every space a marker.  Where no piece of the
vocabulary has a marker after another character, no merge crosses from a word to the next marker, so the
marked words (a run of markers and what follows) are segmented independently.  Each task keeps a table of
the distinct marked words that it met, segments each of them once with the library, and joins the ids
back by position.  A vocabulary whose pieces do cross is encoded text by text with the library instead.

Decoding is the library's own.  Null and empty texts give no ids and an empty text.  Texts are handled in
small slices of bytes (ids as Python numbers take tens of bytes each), the table is emptied when it is full; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .words import passed_on, slices

MARKER = "▁"
MARKED_WORD = re.compile(f"{MARKER}+[^{MARKER}]*")
TABLE_WORDS = 150_000
PIECE_BYTES = 256 << 10


def words_are_independent(model: sentencepiece.SentencePieceProcessor) -> bool:
    """No piece has a marker behind another character, and the text itself is kept as it is."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    probe = "  Åﬁ① á\t　x "  # compatibility forms, tabs, runs of spaces
    return not any(crossing.search(p) for p in pieces) and model.decode(model.encode(probe)) == probe


class WordTable:
    """Distinct marked words: the position of each in one flat array of ids."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model, self.marker = model, model.piece_to_id(MARKER)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, start of each text and the end)."""
        if len(self.known) > TABLE_WORDS:
            self.forget()
        known, new, at, counts = self.known, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = MARKED_WORD.findall(MARKER + text.replace(" ", MARKER))
                counts[i] = len(words)
                for word in words:
                    place = known.get(word)
                    if place is None:
                        place = known[word] = len(known)
                        new.append(word)
                    at.append(place)
        if new:  # the library adds the first marker itself
            found = self.model.encode([w[1:] for w in new], num_threads=1)
            found = [ids if len(w) > 1 else [self.marker] for w, ids in zip(new, found)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter((x for ids in found for x in ids), np.int32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.array(at, np.int64)
        sizes = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        where = np.repeat(self.ends[at] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.ids[where], ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]


def encode_decode(docs: DataFrame, model_path: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, ids array<int> and decoded string for every row of `docs`."""
    with open(model_path, "rb") as f:
        proto = f.read()  # of the size of a vocabulary; travels with the tasks
    by_word = words_are_independent(sentencepiece.SentencePieceProcessor(model_proto=proto))
    source = docs.select(*[F.col(k) for k in keys], F.col(text).alias("body__"))
    names = [f.name for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        table = WordTable(model)
        for b in slices(batches, "body__", PIECE_BYTES):
            texts = b.column("body__").to_pylist()
            if by_word:
                ids, starts = table.encode(texts)
            else:
                each = [model.encode(t) if t else [] for t in texts]
                ids = np.array([x for e in each for x in e], np.int32)
                starts = np.cumsum([0, *map(len, each)])
            flat = ids.tolist()
            decoded = model.decode([flat[s:e] for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())], num_threads=1)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])

    return source.mapInArrow(run, passed_on(source, "ids array<int>, decoded string"))
