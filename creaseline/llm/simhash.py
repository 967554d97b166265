"""SimHash near-duplicates: tiled exact comparison of fingerprints, then components.

Distinct fingerprints are sorted by the population counts of their four quarters and cut into tiles. Two fingerprints
within the radius differ by no more than that in their population counts, so a pair of tiles is compared only
where the counts come that close; there every pair is compared by exclusive-or and bit count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices, texts
from creaseline.llm.components import components, merge_labels

WORDS, SEED, RADIUS = 3, 42, 2
TILE = 4096  # fingerprints: 32 KB
TILES_OF_TASK = 8
QUARTER = 0xFFFF


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of the text's shingles; 0 without a word.

    A-Z are lower-cased, words end at the six ASCII blanks, fewer words than a shingle make one of them all.
    """
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split()  # of bytes: ASCII only
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take = max(1, len(own) - words + 1)
    last = ends[words - 1 :] if len(own) >= words else ends[-1:]
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:take].tolist(), last.tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > take, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the unsigned fingerprint's bits as a long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def _tiles(distinct: DataFrame, rows: int) -> DataFrame:
    """``low, high array<int>, fps binary``: bounds of the quarters' population counts and the fingerprints."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(QUARTER))).alias(f"c{i}") for i in range(4)]
    keys = ["c0", "c1", "c2", "c3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tile(table: np.ndarray) -> pa.RecordBatch:
            low, high = table[:, 1:].min(axis=0).tolist(), table[:, 1:].max(axis=0).tolist()
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([low], kind), pa.array([high], kind), pa.array([table[:, 0].tobytes()])], ["low", "high", "fps"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            size += len(held[-1])
            if size >= TILE:
                table = np.concatenate(held)
                while len(table) >= TILE:
                    yield tile(table[:TILE])
                    table = table[TILE:]
                held, size = [table], len(table)
        if size:
            yield tile(np.concatenate(held))

    ordered = distinct.select("fp", *counts).repartitionByRange(max(1, rows // (TILE * TILES_OF_TASK)), *keys, "fp")
    return ordered.sortWithinPartitions(*keys, "fp").mapInArrow(run, "low array<int>, high array<int>, fps binary")


def _pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """``left, right`` ids of tiles, once each, whose counts come within the radius."""
    meta = tiles.select("tile", "low", "high")
    # met by the first quarter's count, at the smallest value that both reach
    left = meta.select(F.col("tile").alias("left"), F.col("low").alias("ll"), F.col("high").alias("lh"), F.explode(F.expr(f"sequence(low[0] - {radius}, high[0] + {radius})")).alias("at"))
    right = meta.select(F.col("tile").alias("right"), F.col("low").alias("rl"), F.col("high").alias("rh"), F.explode(F.expr("sequence(low[0], high[0])")).alias("at"))
    gap = " + ".join(f"greatest(0, ll[{i}] - rh[{i}], rl[{i}] - lh[{i}])" for i in range(4))
    return left.join(right, "at").where(f"left <= right and at = greatest(ll[0] - {radius}, rl[0]) and {gap} <= {radius}").select("left", "right")


def compare(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints of two tiles as their close pairs do, fewer than there are fingerprints."""
    both = np.concatenate([left, right])
    labels = np.arange(len(both))
    step = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius
        hits = np.flatnonzero(near)
        if len(hits):
            merge_labels(labels, hits // len(right) + at, hits % len(right) + len(left))
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return both[moved], both[labels[moved]]


def links(distinct: DataFrame, keep, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between the fingerprints of ``distinct(fp)`` with the components of all pairs in the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("lf").to_pylist(), batch.column("rf").to_pylist(), strict=True):
                a, b = compare(np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64), radius)
                loop = a != b  # a tile against itself meets every fingerprint twice
                yield pa.RecordBatch.from_arrays([pa.array(a[loop].view(np.int64)), pa.array(b[loop].view(np.int64))], ["a", "b"])

    tiles = keep(_tiles(distinct, distinct.count()).withColumn("tile", F.monotonically_increasing_id()))
    fps = tiles.select("tile", "fps")
    paired = (
        _pairs(tiles, radius)
        .join(fps.select(F.col("tile").alias("left"), F.col("fps").alias("lf")), "left")
        .join(fps.select(F.col("tile").alias("right"), F.col("fps").alias("rf")), "right")
    )
    # pairs cost the same, so they are dealt evenly by size
    return paired.select("lf", "rf").hint("rebalance").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, keep, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: components of fingerprints that differ in ``radius`` bits or fewer.

    ``component_id`` is the smallest doc_id that can be reached. Texts without a word have fingerprint zero and link
    like any other; null doc_ids take part but name no component while another id is there; repeated rows repeat.
    ``keep`` writes a table to shared storage and reads it back.
    """
    members = keep(fingerprints(docs, words, seed))
    distinct = keep(members.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select("fp"), keep, radius), keep).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = keep(distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return members.join(classes, "fp").select("doc_id", "fp", "component_id")
