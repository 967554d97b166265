"""Removal of word passages that stand more than once in the corpus, by seed and extension.

Seeds are winnowed anchors: of the short word grams in a window the one with the smallest hash, the first of equals. Equal
windows choose the same gram at the same offset, so every repeat holds an anchor that repeats, and anchors that stand
alone drop out at once. The windows around one anchor place are neighbours and form a run. An anchor that repeats
is extended to both sides:

* If all its places have the same run, they extend to all of it, and every window in it repeats.
* Otherwise each extension by l words to the left and the rest of the window to the right is compared with those of the
  anchor's other places; the ones that occur again repeat.

Overlapping repeats of a document grow together into maximal ones, none shorter than the threshold. No pairs of places are
made: places meet in counts, which fold before they are shuffled, and in joins with one row per distinct key.

Words, grams and windows are known by 64-bit hashes, places meet by two of them (anchor and window).

Defined results: null and empty texts have no words; texts under the threshold lose nothing; rows equal in doc_id and
text repeat each other like any others, and each gets its result; a null doc_id is an id like others; an empty table
gives an empty one. Columns other than ``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices, texts

WORDS, SEED = 35, 8  # of a window and of a gram
PIECE = 1 << 18  # bytes that are hashed at a time
MULTIPLIER = 0x9E3779B97F4A7C15
SEPARATOR = b"\n"
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    out = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        powers = np.full(PIECE + 1, base, U)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=U))
    return tuple(out)


@cache
def _blank() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a text in UTF-8."""
    codes = np.frombuffer(raw, np.uint8)
    edges = np.diff(np.concatenate([[True], _blank()[codes], [True]]).view(np.int8))
    starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    hashes = np.empty(len(starts), U)
    up, down = _powers()
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(stops, starts[i] + PIECE, "right"))
        if j <= i:  # one word is longer than a piece
            hashes[i] = int.from_bytes(blake2b(raw[starts[i] : stops[i]], digest_size=8).digest(), "little")
            i += 1
            continue
        first, last = starts[i], stops[j - 1]
        sums = np.zeros(last - first + 1, U)
        np.cumsum((codes[first:last].astype(U) + U(1)) * up[: last - first], out=sums[1:])
        a, b = starts[i:j] - first, stops[i:j] - first
        hashes[i:j] = _mix((sums[b] - sums[a]) * down[a])
        i = j
    return hashes, starts


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` neighbours, from hashes of doubled widths."""
    out, have, doubled, wide = None, 0, hashes, 1
    size = len(hashes) - width + 1
    while True:
        if width & wide:
            if out is None:
                out, have = doubled[:], wide
            else:
                out = out[: len(doubled) - have] * U(pow(MULTIPLIER, wide, 1 << 64)) + doubled[have : have + len(out)]
                have += wide
        if have == width:
            return _mix(out[:size])
        factor = U(pow(MULTIPLIER, wide, 1 << 64))
        doubled = doubled[:-wide] * factor + doubled[wide:]
        wide *= 2


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of each ``width`` neighbours."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def runs(raw: list[bytes], words: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of each run in the texts: text, first window, number of windows, hash of its anchor, digest of all it covers."""
    hashes, owner, before = _joined(raw)
    if len(hashes) < words:
        return (*np.zeros((3, 0), np.int64), *np.zeros((2, 0), U))
    grams, windows = _grams(hashes, seed), _grams(hashes, words)
    anchors = _first_least(grams, words - seed + 1)
    valid = np.flatnonzero(owner[: len(windows)] == owner[words - 1 :])
    if len(valid) == 0:
        return (*np.zeros((3, 0), np.int64), *np.zeros((2, 0), U))
    chosen = anchors[valid]
    heads = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    counts = np.diff(np.append(heads, len(valid)))
    first, anchor = valid[heads], chosen[heads]
    # a run has fewer windows than a window has words, so its first and last window hold all of it
    shape = ((anchor - first) << 32 | counts).astype(U)
    digest = _mix(windows[first] ^ _mix(windows[first + counts - 1] + shape * U(MULTIPLIER)))
    return owner[first], first - before[owner[first]], counts, grams[anchor], digest


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, the text of each, and the number of words before each text."""
    sizes = np.array([len(r) + len(SEPARATOR) for r in raw], np.int64)
    hashes, starts = word_hashes(SEPARATOR.join(raw))
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    return hashes, owner, np.searchsorted(owner, np.arange(len(raw)))


ANCHORS = "anchor long, digest long, a long, b int, first int, n int"


def _anchor_rows(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        owner, first, n, anchor, digest = runs(batch.column("text").cast(pa.binary()).to_pylist(), words, seed)
        owner = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), batch.column("a").take(owner), batch.column("b").take(owner), pa.array(first, pa.int32()), pa.array(n, pa.int32())],
            ["anchor", "digest", "a", "b", "first", "n"],
        )


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled."""
    squeeze = pa.Codec("zstd", compression_level=1)
    for batch in slices(batches):
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        out = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        out["packed"] = pa.array([squeeze.compress(r, asbytes=True) for r in raw], pa.binary())
        yield pa.RecordBatch.from_pydict(out | {"size": pa.array(map(len, raw), pa.int64())})


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    squeeze = pa.Codec("zstd")
    both = zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist(), strict=True)
    return [squeeze.decompress(packed, size, asbytes=True) if size else b"" for packed, size in both]


WINDOWS = "anchor long, window long, a long, b int, first int"


def _window_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """One row per window of the runs in ``open``: an extension of the anchor to both sides."""
    for batch in slices(batches, "packed", 1 << 20):
        hashes, _, before = _joined(_unpacked(batch))
        windows = _grams(hashes, words)
        listed = pc.list_value_length(batch.column("open")).to_numpy(zero_copy_only=False)
        flat = batch.column("open").flatten()
        first, n, anchor = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "n", "anchor"))
        of = np.repeat(np.arange(len(listed)), listed)
        run = np.repeat(np.arange(len(n)), n)
        at = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        owner = pa.array(of[run])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[run]), pa.array(windows[before[of[run]] + at].view(np.int64)), batch.column("a").take(owner), batch.column("b").take(owner), pa.array(at, pa.int32())],
            ["anchor", "window", "a", "b", "first"],
        )


def _keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
    for batch in slices(batches, "packed", 1 << 20):
        counts, spans, rest = [], [], []
        for raw, found in zip(_unpacked(batch), batch.column("found").to_pylist(), strict=True):
            own = raw.split()  # of bytes: at the six ASCII blanks
            counts.append(len(own))
            merged = []
            if found:
                steps = np.zeros(len(own) + 1, np.int64)
                np.add.at(steps, [f["first"] for f in found], 1)
                np.add.at(steps, [f["stop"] for f in found], -1)
                covered = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).view(np.int8)))
                merged = [{"first": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
                own = list(compress(own, ~covered))
            spans.append(merged)
            rest.append(b" ".join(own).decode())
        out = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.string())]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "spans", "rest"])


def remove_passages(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, spans array<struct<first, stop>>, rest`` of every row: maximal repeats as word ranges, and the
    words outside of them, joined by one blank.

    A word goes if a window of ``words`` words over it has the same words as one that starts anywhere else. ``keep``
    writes a table that is read more than once. Joins that meet hot keys have one written side and one plain side,
    so that Spark can split a key's rows over tasks.
    """
    if not 0 < seed <= words:
        raise ValueError(f"a seed of {seed} words does not fit into a window of {words}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a row is known by 96 bits of its doc_id and text
    named = texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("a"), F.hash("text").alias("b"))
    packed = named.mapInArrow(_packs, f"doc_id {kind}, a long, b int, packed binary, size long")

    placed = named.select("text", "a", "b").mapInArrow(lambda b: _anchor_rows(b, words, seed), ANCHORS)
    digests = [F.min("digest").alias("low"), F.max("digest").alias("high")]
    seeds = keep(placed.groupBy("anchor").agg(F.count("*").alias("places"), *digests).where("places > 1").select("anchor", (F.col("low") == F.col("high")).alias("agree")))
    places = keep(placed.drop("digest").join(seeds, "anchor"))

    run = F.struct("first", "n", "anchor")
    opened = keep(places.where("not agree").groupBy("a", "b").agg(F.collect_set(run).alias("open")))  # as long as the text
    windows = keep(packed.join(opened, ["a", "b"]).select("a", "b", "packed", "size", "open").mapInArrow(lambda b: _window_rows(b, words), WINDOWS))
    again = keep(windows.groupBy("anchor", "window").count().where("count > 1").drop("count"))

    whole = places.where("agree").select("a", "b", "first", (F.col("first") + F.col("n") + (words - 1)).alias("stop"))
    parts = windows.join(again, ["anchor", "window"]).select("a", "b", "first", (F.col("first") + words).alias("stop"))
    found = keep(whole.unionByName(parts).groupBy("a", "b").agg(F.collect_set(F.struct("first", "stop")).alias("found")))
    out = f"doc_id {kind}, n_words long, spans array<struct<first:long,stop:long>>, rest string"
    return packed.join(found, ["a", "b"], "left").select("doc_id", "packed", "size", "found").mapInArrow(_keep_rest, out)


def digests(kept: DataFrame) -> DataFrame:
    """The counts and the digest of what is left, per row of ``remove_passages``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["first"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("rest", 256).alias("kept_sha256"))
