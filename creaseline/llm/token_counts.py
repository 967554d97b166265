"""Token counts behind a cache of content digests.

The cache is a Parquet table ``(content_digest, tokenizer_digest, n_tokens)``. Only contents that it lacks are
encoded, each distinct one once, and appended; counts come from joining the documents' digests with the table.

A byte-level tokenizer cuts a text into pieces and encodes these one by one, so a task asks the library for the count of
each distinct piece once.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from creaseline.llm.common import slices, texts

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


def library_of(tokenizer: str) -> str:
    return "tokenizers" if tokenizer.endswith(".json") else "sentencepiece"


def tokenizer_digest(tokenizer: str) -> str:
    """Changes with the vocabulary file and with the library's version."""
    library = library_of(tokenizer)
    with open(tokenizer, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {importlib.metadata.version(library)} {content}".encode()).hexdigest()


#: The rule by which a byte-level tokenizer cuts a text into pieces that it then encodes one by one.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are tried one by one; texts with others go to the library whole.
TRIED = [*range(0x300), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]


class PieceCounts:
    """Token counts of texts from those of their distinct pieces, at most ``limit`` of which are kept between texts.

    Only for a tokenizer that encodes pieces one by one, and for texts of characters that it cuts by the rule; other
    texts, and those with a special string, are encoded whole.
    """

    def __init__(self, library, limit: int = 300_000):
        import regex

        self.library, self.limit = library, limit
        self.known: dict[str, int] = {}
        self.pieces = regex.compile(PIECE).findall
        self.whole = None
        if self._piecewise(json.loads(library.to_str())):
            same = "".join(chr(c) for c in TRIED if self._cut_alike(chr(c)))
            special = [regex.escape(token.content) for token in library.get_added_tokens_decoder().values()]
            self.whole = regex.compile("|".join([f"[^{regex.escape(same, special_only=False)}]", *special])).search if same else None

    @staticmethod
    def _piecewise(spec: dict) -> bool:
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        bytes_ = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        return spec["normalizer"] is None and bool(bytes_) and model["type"] == "BPE" and plain

    def _cut_alike(self, c: str) -> bool:
        probe = f"a{c}{c} {c}b 1{c}2 '{c}  {c}\n{c}"
        own = list(accumulate((len(p) for p in self.pieces(probe)), initial=0))
        return [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(probe)] == list(zip(own, own[1:], strict=False))

    def _encoded(self, several: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(several, add_special_tokens=False)]

    def __call__(self, several: list[str]) -> list[int]:
        if self.whole is None:
            return self._encoded(several)
        if len(self.known) > self.limit:
            self.known = {}
        out: list[int | None] = [None] * len(several)
        cut = [None if self.whole(text) else self.pieces(text) for text in several]
        new = list(set().union(*filter(None, cut)) - self.known.keys())
        self.known.update(zip(new, self._encoded(new), strict=True))
        for i, own in enumerate(cut):
            if own is not None:
                out[i] = sum(map(self.known.__getitem__, own))
        rest = [i for i, n in enumerate(out) if n is None]
        for i, n in zip(rest, self._encoded([several[i] for i in rest]), strict=True):
            out[i] = n
        return out


def _counter(tokenizer: str):
    if library_of(tokenizer) == "tokenizers":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        library.no_truncation()
        library.no_padding()
        return PieceCounts(library)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
    return lambda several: [len(x) for x in library.encode(several, num_threads=1)]


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """One row per content; a write that ran twice leaves equal rows, which fold."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], CACHE)
    mine = stored.where(F.col("tokenizer_digest") == tokenizer_digest(tokenizer))
    return mine.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Encode the distinct contents of ``docs`` that ``cache`` lacks and append their counts.

    Copies fold on the map side, so a group of copies sends one text per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in slices(batches, size=1 << 20):
            counts = pa.array(count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), counts], ["content_digest", "n_tokens"])

    stored = read_cache(docs.sparkSession, cache, tokenizer).select("content_digest")
    keyed = texts(docs).select("text", F.unhex(F.sha2("text", 256)).alias("content_digest"))
    missing = keyed.join(stored, "content_digest", "left_anti").dropDuplicates(["content_digest"])
    counted = missing.mapInArrow(run, "content_digest binary, n_tokens long")
    counted.select("content_digest", F.lit(tokenizer_digest(tokenizer)).alias("tokenizer_digest"), "n_tokens").write.mode(
        "append"
    ).parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``; ``cache`` is a folder that all executors reach.

    The content is the text as it stands in UTF-8, null as empty: any folding could change the count. Special
    strings inside a text are handled as the library does by default. Repeated rows give repeated rows.
    """
    fill_cache(docs, tokenizer, cache)
    keyed = texts(docs).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.unhex(F.sha2("text", 256)).alias("content_digest"),
    )
    stored = read_cache(docs.sparkSession, cache, tokenizer)
    return keyed.join(stored, "content_digest").select("doc_id", "n_bytes", "n_tokens")
