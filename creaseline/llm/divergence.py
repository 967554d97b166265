"""Audit of how far the sources of a language differ in their words.

The terms a language keeps are found by iceberg prefix refinement. Byte prefixes of terms are counted by the distinct
documents that hold them; a prefix held by too few is given up with every term that begins so, the others are extended. A
term that is shorter than the level is complete, and its count exact, so refinement ends when no open prefix is left.
Each level is one scan of the texts. Counts fold inside the tasks, so rare words beyond their first bytes are never
shuffled. Between levels travels a bit table of fixed size: a bit that two prefixes share only lets one live a level longer.

Shares are integers: ``p = 1 + floor(SCALE * (count + 1) / (total + vocabulary))``, and a pair of them differs by
``floor((p - q) ** 2 / q)``. Sources are compared over all kept terms of their language, in blocks of terms.

Defined results: null text, language and source count as empty strings; a group without terms is compared like others; a
language without kept terms has pairs of value 0 and no terms; rows that repeat count as documents of their own; an empty
table gives an empty one. Columns other than ``text``, ``lang`` and ``source`` are not looked at, whatever their names.
The pairs of a language's sources are the result, so their number is taken to fit into memory.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from creaseline.llm.common import slices

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
FIRST = 4  # bytes of the first level's prefixes; each further level doubles them
BITS = 25  # logarithm of the bit table's size: 4 MB
HELD = 400_000  # distinct counts that a task holds before it sends them on
BLOCK = 1 << 16  # shares that are compared at a time

#: Bytes of terms, A-Z lower-cased; all others end a term.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


U = np.uint64
#: The bytes of a little-endian word that belong to its first 0 to 8 bytes.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
WORDS = 16  # words of a term that are compared as numbers; what is behind them is compared as it is


class Terms:
    """The terms of some texts in UTF-8: where each stands in ``joined``, its length and its text."""

    def __init__(self, raw: list[bytes]) -> None:
        self.joined = b" ".join(raw).translate(_FOLD) + b" " * 8
        codes = np.frombuffer(self.joined, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], codes != 0x20]).view(np.int8)))
        self.starts = edges[::2]
        self.sizes = edges[1::2] - self.starts
        begin = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
        self.owner = np.repeat(np.arange(len(raw)), np.diff(np.append(np.searchsorted(self.starts, begin), len(self.starts))))

    def only(self, wanted: np.ndarray) -> None:
        self.starts, self.sizes, self.owner = self.starts[wanted], self.sizes[wanted], self.owner[wanted]

    def marks(self, length: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """A hash of each term or of its first ``length`` bytes, and the words that tell these apart."""
        sizes = self.sizes if length is None else np.minimum(self.sizes, length)
        view = np.ndarray(len(self.joined) - 7, "<u8", self.joined, strides=(1,))
        marks, words, more = np.zeros(len(sizes), U), [], np.arange(len(sizes))
        for i in range(WORDS):
            more = more[sizes[more] > 8 * i]
            if len(more) == 0:
                break
            word = np.zeros(len(sizes), U)
            word[more] = view[self.starts[more] + 8 * i] & _FIRST_BYTES[np.minimum(sizes[more] - 8 * i, 8)]
            marks[more] = _mix(marks[more] ^ word[more])
            words.append(word)
        else:
            more = more[sizes[more] > 8 * WORDS]
            known: dict[bytes, int] = {}
            word = np.zeros(len(sizes), U)
            for k in more.tolist():
                rest = self.joined[self.starts[k] + 8 * WORDS : self.starts[k] + sizes[k]]
                word[k] = known.setdefault(rest, len(known) + 1)
                marks[k] ^= U(int.from_bytes(blake2b(rest, digest_size=8).digest(), "little"))
            words.append(word)
        return marks, words

    def groups(self, length: int | None = None) -> tuple[np.ndarray, list[bytes]]:
        """The number of each term's group of equal terms (equal in the first ``length`` bytes), and the groups' terms."""
        marks, words = self.marks(length)
        codes, first = _numbered(marks)
        if any(not np.array_equal(w, w[first][codes]) for w in words):  # different ones with one hash
            _, first, codes = np.unique(np.stack(words), axis=1, return_index=True, return_inverse=True)
        sizes = self.sizes[first] if length is None else np.minimum(self.sizes[first], length)
        starts = self.starts[first]
        return codes, [self.joined[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal values, and the first place of each."""
    codes, uniques = pd.factorize(values)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def _bits(marks: np.ndarray, lang: str) -> np.ndarray:
    """Places in the bit table."""
    seed = int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")
    return _mix(marks ^ U(seed)) >> U(64 - BITS)


def _alive(marks: np.ndarray, lang: str, table: np.ndarray) -> np.ndarray:
    places = _bits(marks, lang)
    return (table[places >> U(3)] >> (places & U(7)).astype(np.uint8)) & 1 == 1


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], list[str]]]:
    """Texts and sources of a language, from one batch after the other."""
    for batch in slices(batches):
        out = defaultdict(lambda: ([], []))
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw, strict=True):
            out[lang][0].append(text)
            out[lang][1].append(source)
        for lang, (texts, sources) in out.items():
            yield lang, texts, sources


def _prefix_rows(batches: Iterator[pa.RecordBatch], length: int, before: int, table: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """``lang, prefix, docs``: documents with a term of that prefix, of terms whose shorter prefix of ``before`` bytes lives."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            columns = [pa.array([lang] * len(counter), pa.string()), pa.array(counter.keys(), pa.binary()), pa.array(counter.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "docs"])
        counts.clear()

    for lang, texts, _ in _by_lang(batches):
        found = Terms(texts)
        if table is not None:
            found.only(found.sizes >= before)
            found.only(_alive(found.marks(before)[0], lang, table.value))
        if len(found.starts) == 0:
            continue
        codes, prefixes = found.groups(length)
        once = np.sort(codes * len(texts) + found.owner)
        once = once[np.append(True, once[1:] != once[:-1])]
        docs = np.bincount(once // len(texts), minlength=len(prefixes))
        counts[lang].update(dict(zip(prefixes, docs.tolist(), strict=True)))
        if sum(map(len, counts.values())) > HELD:
            yield from sent()
    yield from sent()


def _term_rows(batches: Iterator[pa.RecordBatch], table: Broadcast) -> Iterator[pa.RecordBatch]:
    """``lang, term, counts array<struct<source, n>>``: occurrences of terms that have their bit."""
    kind = pa.struct([("source", pa.string()), ("n", pa.int64())])
    numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
    places: dict[str, dict[str, int]] = defaultdict(dict)
    held: dict[str, list[np.ndarray]] = defaultdict(list)

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            term, source, n = _summed(np.concatenate(parts, axis=1))
            names = pa.array(places[lang].keys(), pa.string()).take(pa.array(source))
            heads = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            listed = pa.ListArray.from_arrays(pa.array(np.append(heads, len(term)), pa.int32()), pa.StructArray.from_arrays([names, pa.array(n)], fields=list(kind)))
            own = pa.array(numbers[lang].keys(), pa.binary()).take(pa.array(term[heads]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(heads), pa.string()), own, listed], ["lang", "term", "counts"])
        for kept in (numbers, places, held):
            kept.clear()

    for lang, texts, sources in _by_lang(batches):
        found = Terms(texts)
        found.only(_alive(found.marks()[0], lang, table.value))
        if len(found.starts) == 0:
            continue
        codes, names = found.groups()
        known, listed = numbers[lang], places[lang]
        number = np.array([known.setdefault(t, len(known)) for t in names])
        place = np.array([listed.setdefault(s, len(listed)) for s in sources])
        held[lang].append(_summed(np.stack([number[codes], place[found.owner], np.ones(len(codes), np.int64)])))
        if sum(p.shape[1] for parts in held.values() for p in parts) > 4 * HELD:
            yield from sent()
    yield from sent()


def _summed(rows: np.ndarray) -> np.ndarray:
    """``term, source, n`` summed over equal terms and sources, in their order."""
    wide = rows[1].max() + 1
    keys = rows[0] * wide + rows[1]
    if len(keys) == rows[2].sum():  # all ones
        keys = np.sort(keys)
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(heads, len(keys)))
    else:
        order = np.argsort(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.add.reduceat(rows[2][order], heads)
    return np.stack([keys[heads] // wide, keys[heads] % wide, n])


def _bit_table(listed: DataFrame) -> Broadcast:
    """A bit for each ``lang, prefix``. What the driver gets is a row per 64 bits at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, prefixes = batch.column("lang").to_pylist(), batch.column("prefix").to_pylist()
            by = defaultdict(list)
            for lang, prefix in zip(langs, prefixes, strict=True):
                by[lang].append(prefix)
            for lang, own in by.items():
                yield pa.RecordBatch.from_arrays([pa.array(_bits(Terms(own).marks()[0], lang).astype(np.int64))], ["at"])

    rows = listed.select("lang", "prefix").mapInArrow(places, "at long").selectExpr("shiftright(at, 6) as word", "shiftleft(1L, cast(at & 63 as int)) as bit")
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return listed.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def kept_terms(named: DataFrame, keep: Callable[[DataFrame], DataFrame], least: int = LEAST) -> DataFrame:
    """``lang, prefix binary, docs``: every term that at least ``least`` documents of its language hold. ``named`` has
    ``lang`` and ``text`` without nulls; ``keep`` writes a level's prefixes."""
    length, before, table, done = FIRST, 0, None, []
    while True:
        rows = named.mapInArrow(lambda b, a=(length, before, table): _prefix_rows(b, *a), "lang string, prefix binary, docs long")
        level = keep(rows.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least))
        done.append(level.where(F.octet_length("prefix") < length))
        pending = level.where(F.octet_length("prefix") == length)
        if pending.isEmpty():
            break
        length, before, table = 2 * length, length, _bit_table(pending)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return keep(out)


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """A term's smoothed share, exact for any counts."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", scaled, (total + vocabulary).cast("decimal(29,0)")) + 1


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(block: pa.Table) -> pa.Table:
    """Sums over a block's terms for each pair of sources. Rows without a term give a source's share of absent terms."""
    present = block.filter(pa.compute.is_valid(block["term"]))
    absent = block.filter(pa.compute.is_null(block["term"])).sort_by("source")
    sources = absent["source"].combine_chunks()
    shares = absent["p"].fill_null(1).to_numpy()
    codes = present["term"].combine_chunks().dictionary_encode()
    matrix = np.tile(shares, (len(codes.dictionary), 1))
    at = pa.compute.index_in(present["source"].combine_chunks(), sources).to_numpy()
    matrix[codes.indices.to_numpy(), at] = present["p"].to_numpy()
    size = len(sources)
    values = np.empty((size, size), np.int64)
    for i in range(size):
        gap = matrix[:, i : i + 1] - matrix
        values[i] = (gap * gap // matrix).sum(axis=0)
    one, other = np.divmod(np.flatnonzero(~np.eye(size, dtype=bool)), max(size, 1))
    lang = pa.array([block["lang"][0].as_py()] * len(one), pa.string())
    return pa.table({"lang": lang, "source": sources.take(pa.array(one)), "item": sources.take(pa.array(other)), "value": pa.array(values[one, other])})


def divergence(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language how far the others are (``pair``), and its
    ``top`` terms that the language as a whole uses less (``term``)."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vocabulary = kept_terms(named, keep, least)
    table = _bit_table(vocabulary)
    counted = named.mapInArrow(lambda b: _term_rows(b, table), "lang string, term binary, counts array<struct<source:string,n:long>>")
    counted = counted.repartition("lang", "term").select("lang", "term", F.inline("counts"))  # one row per term and task
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    counts = keep(counted.join(vocabulary.select("lang", F.col("prefix").alias("term")), ["lang", "term"], "left_semi"))

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("vocabulary"))
    groups = named.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = keep(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary")))
    whole = Window.partitionBy("lang")
    langs = groups.select("*", F.count("*").over(whole).alias("sources"), F.sum("total").over(whole).alias("lang_total"))
    groups = keep(langs.withColumn("blocks", F.expr(f"vocabulary * sources div {BLOCK} + 1")))

    everywhere = Window.partitionBy("lang", "term")
    shares = counts.withColumn("lang_n", F.sum("n").over(everywhere)).join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("q"),
        F.pmod(F.xxhash64("term"), "blocks").alias("block"),
    )
    shares = keep(shares)

    none = F.when(F.col("vocabulary") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("vocabulary")))
    absent = groups.select("lang", "source", F.lit(None).cast("binary").alias("term"), none.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = shares.select("lang", "source", "term", "p", "block").unionByName(absent)
    sums = blocks.groupBy("lang", "block").applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    more = shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _difference(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, more = (part.withColumn("rank", F.row_number().over(order)) for part in (pairs, more))
    columns = [["lang", "source", F.lit(name).alias("part"), "item", "value", "rank"] for name in ("pair", "term")]
    return pairs.select(*columns[0]).unionByName(more.where(F.col("rank") <= top).select(*columns[1]))
