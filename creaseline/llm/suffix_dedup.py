"""Removal of long byte strings that start earlier in the corpus, by suffix arrays of content-defined shards.

A string of ``LENGTH`` bytes belongs to the smallest hash of the short grams in it, so equal strings belong to one hash
wherever they stand, and a run of neighbouring strings with one hash is a segment. Hashes that stand alone in the
corpus cannot hold a repeat, unless the segment is periodic. The texts of the other segments are gathered by hash; each shard of them is
suffix-sorted by induction, and strings that share a prefix of ``LENGTH`` bytes are found side by side. The
hash only decides where strings meet; what is removed follows from the suffix array's common prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices, texts
from creaseline.llm.suffix_array import common_prefixes, suffix_ranks
from creaseline.session import materialize

LENGTH = 100
GRAM = 20
SHARD = 1 << 18  # bytes of a suffix array, or one hash's segments if they have more
MULTIPLIER = 0x9E3779B97F4A7C15
FAR = np.int64(1) << np.int64(32)
#: A place in 63 bits: 21 of the text's digest, 30 of the first string, 12 of the number of strings.
START_AT, TAG_AT = 12, 42
MOST, LAST_START, LAST_TAG = (1 << 12) - 1, (1 << 30) - 1, (1 << 21) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _doubled(values: np.ndarray, width: int, join) -> np.ndarray:
    """Fold each ``width`` neighbours with ``join(left, right, width of right)`` in a logarithm of passes."""
    out, have = values, 1
    while have * 2 <= width:
        out = join(out[:-have], out[have:], have)
        have *= 2
    if have < width:
        gap = width - have
        # minima may overlap; hashes take the rest on their own
        out = join.rest(values, out, gap, have) if hasattr(join, "rest") else join(out[:-gap], out[gap:], gap)
    return out


class _Polynomial:
    def __call__(self, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        return left * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + right

    def rest(self, values: np.ndarray, out: np.ndarray, gap: int, have: int) -> np.ndarray:
        tail = _doubled(values, gap, self)[have : have + len(out) - gap]
        return self(out[: len(tail)], tail, gap)


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first string and number of strings of each segment of a text, and whether it may repeat itself."""
    if len(raw) < length:
        return (*np.zeros((3, 0), np.int64), np.zeros(0, bool))
    codes = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    hashes = _mix(_doubled(codes, gram, _Polynomial()))
    width = length - gram + 1
    least = _doubled(hashes, width, lambda a, b, _: np.minimum(a, b))
    # a gram is smallest in a string around it if it is the largest minimum there; a segment with two of them is periodic
    edge = np.zeros(width - 1, np.uint64)
    chosen = hashes[_doubled(np.concatenate([edge, least, edge]), width, lambda a, b, _: np.maximum(a, b)) == hashes]
    twice = chosen[1:][chosen[1:] == chosen[:-1]]
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(np.append(starts, len(least)))
    if counts.max() > MOST:  # only to fit a field: a long run becomes several segments of one hash
        pieces = -(-counts // MOST)
        which = np.repeat(np.arange(len(starts)), pieces)
        into = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = starts[which] + into * MOST
        counts = np.minimum(counts[which] - into * MOST, MOST)
    own = least[starts]
    return own.view(np.int64), starts, counts, np.isin(own, twice) if len(twice) else np.zeros(len(own), bool)


PLACES = "hash long, doc_id long, more long, place long"
#: Bits of a hash that are given to flags: the segment is known to repeat; it is not its batch's first.
KNOWN, LATER = 1, 2


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled."""
    squeeze = pa.Codec("zstd", compression_level=1)
    for batch in slices(batches):
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        packed = pa.array([squeeze.compress(r, asbytes=True) for r in raw], pa.binary())
        out = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        yield pa.RecordBatch.from_pydict(out | {"packed": packed, "size": pa.array(map(len, raw), pa.int64())})


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    squeeze = pa.Codec("zstd")
    for packed, size in zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist(), strict=True):
        yield squeeze.decompress(packed, size, asbytes=True) if size else b""


def _places(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """One row per segment: its hash with two flags, and the text's tag, the first string and the number of strings."""
    for batch in slices(batches, size=8 << 20):
        found = [segments(t.encode(), length, gram) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(f[0]) for f in found], np.int64)
        if sizes.sum() == 0:
            continue
        hashes, starts, counts, periodic = (np.concatenate([f[i] for f in found]) for i in range(4))
        owner = np.repeat(np.arange(len(found)), sizes)
        tags = batch.column("tag").to_numpy(zero_copy_only=False)[owner]
        place = (tags << TAG_AT) | (starts << START_AT) | counts
        base = hashes & ~np.int64(KNOWN | LATER)
        order = np.argsort(base, kind="stable")
        ordered = base[order]
        later = np.append(False, ordered[1:] == ordered[:-1])
        flags = np.empty(len(base), np.int64)
        flags[order] = np.where(later, LATER, 0) | np.where(later | np.append(later[1:], False), KNOWN, 0)
        flags |= np.where(periodic, KNOWN, 0)
        owner = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(base | flags), batch.column("doc_id").take(owner), batch.column("more").take(owner), pa.array(place)],
            ["hash", "doc_id", "more", "place"],
        )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash those that are known to repeat or have a neighbour of their hash; one row is held back."""
    held: pa.RecordBatch | None = None
    held_hit = False

    def out(batch: pa.RecordBatch, hit: np.ndarray) -> pa.RecordBatch:
        batch = batch.filter(pa.array(hit))
        clean = batch.column("hash").to_numpy(zero_copy_only=False) & ~np.int64(KNOWN | LATER)
        rest = {name: batch.column(name) for name in ("doc_id", "more", "place")}
        return pa.RecordBatch.from_pydict({"hash": pa.array(clean)} | rest)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        hashes = batch.column("hash").to_numpy(zero_copy_only=False)
        same = (hashes[1:] >> 2) == (hashes[:-1] >> 2)
        hit = ((hashes & KNOWN) != 0) | np.append(same, False) | np.append(False, same)
        hit[0] |= held_hit
        held, held_hit = batch.slice(len(hashes) - 1, 1), bool(hit[-1])
        yield out(batch.slice(0, len(hashes) - 1), hit[:-1])
    if held is not None and held_hit:
        yield out(held, np.array([True]))


SEGMENT = "hash long, doc_id long, more long, place long, bytes binary"


def _text(doc_id: int | None, more: int | None, place: int) -> tuple:
    """Which text a place is in, in the order of the texts; a null doc_id is the last."""
    return doc_id is None, doc_id or 0, more or 0, place >> TAG_AT


def _order(doc_id: int | None, more: int | None, place: int) -> tuple:
    """Which of two places is earlier."""
    return *_text(doc_id, more, place), place >> START_AT


def _texts_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The texts of the listed segments. Of equal segments in a batch all but the first are sent without text: their
    strings start earlier, in the one that is sent."""
    names, kinds = ["hash", "doc_id", "more", "place", "bytes"], [pa.int64()] * 4 + [pa.binary()]
    for batch in slices(batches, "packed", 8 << 20):
        first: dict[tuple[int, bytes], tuple] = {}
        rows = []
        ids, mores = batch.column("doc_id").to_pylist(), batch.column("more").to_pylist()
        for doc_id, more, raw, wanted in zip(ids, mores, _unpacked(batch), batch.column("wanted").to_pylist(), strict=True):
            for entry in wanted or []:
                place, hash_ = entry["place"], entry["hash"]
                start, strings = place >> START_AT & LAST_START, place & MOST
                own = raw[start : start + strings + length - 1]
                mine = doc_id, more, place
                other = first.setdefault((hash_, own), mine)
                if other is mine or other == mine:
                    continue
                if _order(*mine) < _order(*other):
                    first[hash_, own] = mine
                    mine = other
                rows.append((hash_, *mine, None))
        rows += [(hash_, *mine, own) for (hash_, own), mine in first.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


#: ``at``: the text's tag and the first byte to go; ``stop``: the byte behind the last.
RUN = "doc_id long, more long, at long, stop long"


def shard_repeats(held: list[tuple], length: int) -> Iterator[tuple]:
    """Runs of bytes to remove, as RUN, for the segments ``(doc_id, more, place, bytes)`` of a shard."""
    held = sorted(held, key=lambda r: (r[3], _order(*r[:3])))
    distinct = []
    for row in held:  # an equal segment starts earlier as a whole
        if distinct and distinct[-1][3] == row[3]:
            if row != distinct[-1]:  # a repeated row is the same document
                yield whole(*row[:3], len(row[3]))
        else:
            distinct.append(row)
    distinct.sort(key=lambda r: _order(*r[:3]))
    text = np.frombuffer(b"".join(r[3] for r in distinct), np.uint8)
    sizes = np.array([len(r[3]) for r in distinct])
    strings = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(distinct)), strings)
    into = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    places = begin[owner] + into
    order = np.argsort(suffix_ranks(text, places))
    before = np.full(len(places), -1)
    before[order[1:]] = places[order[:-1]]
    shares = common_prefixes(text, places, before, length)
    # earliest string of each group of equal ones; documents are numbered in their order
    at = np.array([r[2] >> START_AT for r in distinct])
    documents = np.cumsum([0] + [_text(*a[:3]) != _text(*b[:3]) for a, b in zip(distinct, distinct[1:], strict=False)])
    when = documents[owner] * FAR + (at & LAST_START)[owner] + into
    heads = np.flatnonzero(~shares[order])
    earliest = np.minimum.reduceat(when[order], heads)
    later = np.empty(len(places), bool)
    later[order] = when[order] > np.repeat(earliest, np.diff(np.append(heads, len(order))))
    hits = np.flatnonzero(later)
    if len(hits) == 0:
        return
    breaks = np.flatnonzero((np.diff(hits) != 1) | (owner[hits[1:]] != owner[hits[:-1]]))
    for a, b in zip(hits[np.append(0, breaks + 1)].tolist(), hits[np.append(breaks, len(hits) - 1)].tolist(), strict=True):
        first = int(at[owner[a]])
        yield *distinct[owner[a]][:2], first + int(into[a]), (first & LAST_START) + int(into[b]) + length


def whole(doc_id: int | None, more: int | None, place: int, size: int) -> tuple:
    return doc_id, more, place >> START_AT, (place >> START_AT & LAST_START) + size


def _shards(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash; a suffix array takes whole hashes until it has ``size`` bytes."""
    held: list[tuple] = []
    total, last = 0, None

    def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "more", "at", "stop"])

    for batch in batches:
        done = []
        for hash_, doc_id, more, place, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own is None:
                done.append(whole(doc_id, more, place, (place & MOST) + length - 1))
                continue
            if total >= size and hash_ != last:
                done += shard_repeats(held, length)
                held, total = [], 0
            held.append((doc_id, more, place, own))
            total, last = total + len(own), hash_
        yield from packed(done)
    if held:
        yield from packed(list(shard_repeats(held, length)))


def _keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "packed", 2 << 20):
        kept, spans = [], []
        for raw, runs in zip(_unpacked(batch), batch.column("runs").to_pylist(), strict=True):
            merged = []
            for start, stop in sorted((r["at"] & LAST_START, r["stop"]) for r in runs or []):
                if merged and start <= merged[-1]["stop"]:
                    merged[-1]["stop"] = max(merged[-1]["stop"], stop)
                else:
                    merged.append({"start": start, "stop": stop})
            bounds = [0, *(x for m in merged for x in (m["start"], m["stop"])), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            spans.append(merged)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        out = {"doc_id": batch.column("doc_id"), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)}
        if "record" in batch.schema.names:
            out["record"] = batch.column("record")
            out["rest"] = pa.array([k.decode(errors="ignore") for k in kept], pa.string())
        yield pa.RecordBatch.from_pydict(out)


def _told_apart(named: DataFrame, keep: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """``named`` with ``more``, a second digest of the text where the doc_id has several texts or is null."""
    digest = F.xxhash64(F.lit(LENGTH), "text")
    shared = named.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("digest")).groupBy(F.col("doc_id").alias("shared"))
    shared = (keep or materialize)(shared.agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("shared"))
    if shared.isEmpty():
        return named.withColumn("more", F.when(F.col("doc_id").isNull(), digest))
    joined = named.join(shared, named["doc_id"] == shared["shared"], "left")
    return joined.withColumn("more", F.when(F.col("shared").isNotNull() | F.col("doc_id").isNull(), digest)).drop("shared")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, carry: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``doc_id, kept binary, spans array<struct<start, stop>>`` of every row of ``docs``.

    A byte goes if some string of ``length`` bytes over it also starts earlier: in a smaller doc_id, or earlier in the
    same text. Strings are judged on the input. Texts are compared as UTF-8 bytes, so ``kept`` may begin or end inside a
    character. Null texts count as empty. Rows equal in doc_id and text are one document and all get its result; a null
    doc_id comes last. Different texts under one doc_id, or under none, are told apart and ordered by 85 bits of two
    digests; where an id has one text, the second digest is left out of what is shuffled.

    With ``carry`` there are two more columns: ``record``, the row of ``docs`` but for its text, and ``rest``, the kept
    bytes as a text without broken characters. The texts are shuffled once and read by both joins.
    """
    others = [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns if carry and c != "text"]
    named = texts(docs, *([F.struct(*others).alias("record")] if carry else [])).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.xxhash64("text").bitwiseAND(F.lit(LAST_TAG)).alias("tag"),
        *(["record"] if carry else []),
    )
    named = _told_apart(named, keep)
    record = f"record {named.schema['record'].dataType.simpleString()}, " if carry else ""
    packed = named.mapInArrow(_packs, f"doc_id long, tag long, {record}more long, packed binary, size long")

    def spread(hash_: F.Column, anywhere: F.Column) -> F.Column:
        """The hash's task, but for rows that need not meet others: a common passage does not gather in one task."""
        return F.when(anywhere, F.xxhash64("doc_id", "more", "place")).otherwise(hash_)

    placed = named.select("doc_id", "more", "text", "tag").mapInArrow(lambda b: _places(b, length, gram), PLACES)
    dealt = placed.repartition(spread(F.shiftright("hash", 2), F.col("hash").bitwiseAND(F.lit(LATER)) != 0))
    repeated = dealt.sortWithinPartitions("hash").mapInArrow(_repeated, PLACES)
    wanted = (
        repeated.groupBy(F.col("doc_id").alias("of"), F.col("more").alias("and"), F.shiftrightunsigned("place", TAG_AT).alias("with"))
        .agg(F.collect_list(F.struct("place", "hash")).alias("wanted"))
    )  # as long as the document

    def beside(listed: DataFrame) -> DataFrame:
        same = packed["doc_id"].eqNullSafe(listed["of"]) & packed["more"].eqNullSafe(listed["and"]) & (packed["tag"] == listed["with"])
        return packed.join(listed, same, "left").drop("of", "and", "with")

    sent = beside(wanted).mapInArrow(lambda b: _texts_of(b, length), SEGMENT)
    shards = sent.repartition(spread(F.col("hash"), F.col("bytes").isNull())).sortWithinPartitions("hash")
    runs = shards.mapInArrow(lambda b: _shards(b, length, shard), RUN)
    listed = (
        runs.groupBy(F.col("doc_id").alias("of"), F.col("more").alias("and"), F.shiftrightunsigned("at", TAG_AT - START_AT).alias("with"))
        .agg(F.collect_list(F.struct("at", "stop")).alias("runs"))
    )
    more = f", {record}rest string" if carry else ""
    return beside(listed).mapInArrow(_keep_rest, f"doc_id long, kept binary, spans array<struct<start:long,stop:long>>{more}")


def digests(kept: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return kept.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
