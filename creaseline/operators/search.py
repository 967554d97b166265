"""Text search as batch jobs over a document table.

Texts are analysed whole and in place. Searches that a stored index answers are in ``textindex``.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from creaseline.operators.scans import laid_out

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BREAK = r"[^\w]+"
#: The same by bytes of UTF-8, of which words hold only ASCII ones, and their lower case.
WORD_BYTES = np.array([b < 128 and (chr(b).isalnum() or chr(b) == "_") for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SLICE_BYTES = 4 << 20  # of texts taken at once
POSTING = T.StructType().add("dl", T.IntegerType()).add("term", T.StringType()).add("frequency", T.LongType()).add("positions", T.ArrayType(T.IntegerType()))
# Stop words, one-way synonyms (target: alternatives) and character mappings.
STOP_WORDS = ["a", "an", "the", "and", "or"]
SYNONYMS = {
    "iphone": ["apple phone"],
    "laptop": ["notebook"],
    "tv": ["television"],
    "sneakers": ["trainers", "running shoes"],
}
CHARACTERS = {"&": "and", "@": "at"}
# Elements that do not separate words, and the entities that are decoded.
INLINE = (
    "a abbr acronym b basefont bdo big cite code dfn em font i img input kbd label q s samp select "
    "small span strike strong sub sup textarea tt u var"
).split()
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
HTML_RULES = [
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n"),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(" + "|".join(INLINE) + r")(\s[^>]*)?/?>", ""),
    (r"(?s)<[^>]*>", "\n"),
]
# The parameters of BM25.
K1, B = 1.2, 0.75


def strip_html(html: Column) -> Column:
    for pattern, replacement in HTML_RULES:
        html = F.regexp_replace(html, pattern, replacement)
    for entity, char in ENTITIES.items():
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    return F.transform(words, F.lower)


def replace_synonyms(text: Column, rules: dict[str, list[str]]) -> Column:
    """One-way rules on a blank-separated token text, longest alternative first."""
    pairs = sorted(((alt, target) for target, alts in rules.items() for alt in alts), key=lambda p: (-len(p[0]), p[0]))
    for alternative, target in pairs:
        text = F.regexp_replace(text, rf"\b{re.escape(alternative)}\b", target)
    return text


def analyze(html: Column, rules: dict[str, list[str]] | None = None, stop: list[str] | None = None) -> Column:
    """Analyzer chain: strip HTML, map characters, tokenise, lower, synonyms, stop words."""
    text = strip_html(html)
    for char, word in CHARACTERS.items():
        text = F.replace(text, F.lit(char), F.lit(word))
    joined = replace_synonyms(F.array_join(tokens(text), " "), SYNONYMS if rules is None else rules)
    kept = STOP_WORDS if stop is None else stop
    return F.filter(F.split(joined, " "), lambda w: (w != "") & ~w.isin(kept))


def _posted(batch: pa.RecordBatch, text: str, keep: list[str]) -> pa.RecordBatch:
    """Postings of a batch: the bytes of words are copied out, coded, and sorted by document and code at once."""
    column = pc.fill_null(batch.column(text), "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = WORD_BYTES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    begins[edges] = inside[edges]  # words do not go on into the next text
    offsets = np.append(np.flatnonzero(begins[inside]), inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(ends, np.flatnonzero(begins), "right") - 1
    dl = np.bincount(row, minlength=len(column)).astype(np.int32)
    places = (np.arange(len(row)) - (np.cumsum(dl) - dl)[row]).astype(np.int32)
    key = row * max(len(words.dictionary), 1) + codes
    order = np.argsort(key, kind="stable")
    runs = np.flatnonzero(np.diff(key[order], prepend=-1))
    first, bounds = order[runs], np.append(runs, len(order))
    n, rows = len(column), pa.array(np.append(np.arange(len(column)), row[first]))
    lengths = pa.array(dl, mask=batch.column(text).is_null().to_numpy(zero_copy_only=False))
    positions = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places[order]))
    out = [batch.column(c).take(rows) for c in keep] + [lengths.take(rows)]
    for values in (words.dictionary.take(pa.array(codes[first])), pa.array(np.diff(bounds), pa.int64()), positions):
        out.append(pa.concat_arrays([pa.nulls(n, values.type), values]))
    return pa.RecordBatch.from_arrays(out, [*keep, "dl", "term", "frequency", "positions"])


def postings(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns, ``dl`` (words of the text; null for a null text), ``term``, ``frequency`` and ``positions``: one row
    per distinct word of a text, and one with a null term per text.

    A document is one row, so its postings are grouped in place. Nothing is shuffled. Words are those of :func:`tokens`.
    """
    names, rows = list(keep), df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_before = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy())
            part = bytes_before // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield _posted(batch.slice(low, high - low), "_text", names)

    return rows.mapInArrow(run, T.StructType([*df.select(*keep).schema, *POSTING]))


def inverted_index(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, document) with frequency and positions. ``textindex`` stores the same with block bounds."""
    return postings(df, text, doc).where("term IS NOT NULL").select("term", doc, "frequency", "positions")


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def fuzzy_hits(words: Column, query: list[str]) -> Column:
    """How many query terms have a word within the edit distance their length allows."""

    def found(term: str) -> Column:
        return F.exists(words, lambda w: F.levenshtein(w, F.lit(term), edits_allowed(term)) >= 0).cast("int")

    return reduce(add, [found(q) for q in query])


def best_field(fields: dict[str, float], query: list[str]) -> Column:
    """Highest boosted field score."""
    scores = [fuzzy_hits(tokens(F.col(c)), query) * F.lit(float(boost)) for c, boost in fields.items()]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def multi_match(df: DataFrame, fields: dict[str, float], query: list[str]) -> DataFrame:
    return df.withColumn("score", best_field(fields, query)).where("score > 0")


def gauss_decay(value: Column, origin: float, scale: float, offset: float, decay: float = 0.5) -> Column:
    distance = F.greatest(F.abs(value - origin) - offset, F.lit(0.0))
    return F.exp(distance * distance * F.lit(math.log(decay) / (scale * scale)))


def function_score(filters: list[tuple[Column, float]], factors: list[Column]) -> Column:
    """Product of the weights whose filter matches and of the factor functions; it replaces the query score."""
    score = F.lit(1.0)
    for condition, weight in filters:
        score = score * F.when(condition, F.lit(weight)).otherwise(F.lit(1.0))
    for factor in factors:
        score = score * factor
    return score


def log1p_factor(value: Column, factor: float) -> Column:
    """Common logarithm of 1 + factor * value."""
    return F.log10(F.lit(1.0) + F.lit(factor) * value)


def script_score(rating: Column, sales: Column, stock: Column) -> Column:
    """rating * 10 + ln(sales + 1) * 5, a tenth of that when out of stock; absent values add nothing."""
    score = F.coalesce(rating * 10, F.lit(0.0)) + F.coalesce(F.log(sales + 1) * 5, F.lit(0.0))
    return F.when(stock == 0, score * 0.1).otherwise(score)


def highlight(text: Column, terms: list[str]) -> Column:
    """Wrap whole-word hits, in any case, in ``<em>``."""
    words = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])", "<em>$1</em>")


def completions(df: DataFrame, name: str, size: int = 10) -> DataFrame:
    """``prefix, number, name``: the first ``size`` distinct names of every lower-case prefix, the empty one included, in
    the order of prefixes. Map tasks keep no more than that of a prefix. A name gives as many rows as it has characters,
    so this is for names, not for texts; null names have no prefix."""
    names = df.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().withColumn("lowered", F.lower("name"))
    lengths = F.sequence(F.lit(0), F.char_length("lowered"))
    rows = names.select(F.explode(F.transform(lengths, lambda n: F.substr("lowered", F.lit(1), n))).alias("prefix"), "name")
    number = F.row_number().over(Window.partitionBy("prefix").orderBy("name"))
    return laid_out(rows.withColumn("number", number).where(F.col("number") <= size).select("prefix", "number", "name"), "prefix", "number")


def suggestions(stored: DataFrame, prefix: str) -> DataFrame:
    """Names of one prefix of ``completions``, in order; the filter reaches the files."""
    return stored.where(F.col("prefix") == prefix.lower()).orderBy("number").select("name")


def expand(query: str, groups: list[list[str]]) -> list[str]:
    """Multi-way synonyms: every phrase of a group stands for all of them."""
    for group in groups:
        if query in group:
            return group
    return [query]


def match_any_phrase(df: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    padded = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    hits = [F.contains(padded, F.lit(f" {p} ")) for p in phrases]
    return df.where(reduce(or_, hits))
