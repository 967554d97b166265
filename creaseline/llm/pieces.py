"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model whose pieces carry the whitespace marker only at their front, no merge reaches over the place where
a marker follows another character, so a text may be cut there. A newline that only exists as a byte piece is a
cut on both sides. Every distinct chunk is segmented once by the library; a text's ids are the chunks' ids joined
by position. Where a model lacks these properties the whole text is the chunk.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices, texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class ChunkTable:
    """Ids of distinct chunks, at most ``limit`` of them kept between texts."""

    def __init__(self, model: str, limit: int = 300_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.limit = limit
        self.ids: dict[str, bytes] = {}
        self.lossy: dict[str, str] = {}
        self.separable = self._separable()

    def _separable(self) -> bool:
        sp = self.library
        pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            return False
        # the normaliser must leave blanks and compatibility forms alone and put one marker in front
        probe = " a  ﬁ²Ａ \n b "
        return (
            sp.decode(sp.encode(probe)) == probe
            and sp.encode("\n", out_type=str) == [MARK, "<0x0A>"]
            and sp.encode("\na")[2:] != sp.encode("a")
        )

    def _learn(self, chunks: set[str]) -> None:
        """A newline in front keeps the library's own leading marker away from the chunk."""
        new = list(chunks)
        for chunk, ids in zip(new, self.library.encode(["\n" + c for c in new], num_threads=1), strict=True):
            self.ids[chunk] = array("i", ids[2:]).tobytes()
            surface = self.library.decode(ids)[1:]
            if surface != chunk.replace(MARK, " "):
                self.lossy[chunk] = surface

    def encode(self, several: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as packed 32-bit integers and the decoded text."""
        if not self.separable:
            every = self.library.encode(several, num_threads=1)
            return [(array("i", ids).tobytes(), self.library.decode(ids) if ids else "") for ids in every]
        if len(self.ids) > self.limit:
            self.ids, self.lossy = {}, {}
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in several]
        chunks = [CHUNK.findall(t) for t in marked]
        if missing := set().union(*chunks) - self.ids.keys():
            self._learn(missing)
        out = []
        for text, own in zip(marked, chunks, strict=True):
            plain = text[1:].replace(MARK, " ")
            if self.lossy and not self.lossy.keys().isdisjoint(own):
                plain = "".join(self.lossy.get(c) or c.replace(MARK, " ") for c in own)[1:]
            out.append((b"".join(map(self.ids.__getitem__, own)), plain))
        return out


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for every row of ``docs``.

    Null and empty texts have no ids and decode to the empty string; repeated rows give repeated rows. Texts are
    never cut at a length. ``model`` is a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(model)
        for batch in slices(batches, size=2 << 20):
            rows = known.encode(batch.column("text").to_pylist())
            flat = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.int32)
            ends = np.cumsum([0] + [len(r[0]) // 4 for r in rows], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array([r[1] for r in rows], pa.string())], ["doc_id", "ids", "decoded"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Number of ids, digest of the ids in decimal, digest of the decoded text, and the named columns."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
