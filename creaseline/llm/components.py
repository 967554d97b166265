"""Connected components of a table of links.

Tasks contract the links that they hold into stars; between that, alternating large and small stars carry
minima from task to task. A round is a few shuffles with map-side minima and a written table, so lost executors
cost tasks of a round at most; nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HELD = 1_000_000  # links that a task contracts at once


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places one label, the smallest place of their component."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (shorter := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = shorter


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars with the components of the links seen so far, ``HELD`` new ones at a time."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[pa.RecordBatch] = []

    def fold() -> None:
        nonlocal a, b
        a, b = (np.concatenate([own, *(w.column(i).to_numpy(zero_copy_only=False) for w in waiting)]) for i, own in enumerate((a, b)))
        waiting.clear()
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = np.arange(len(nodes))
        merge_labels(labels, place[: len(a)], place[len(a) :])
        moved = np.flatnonzero(labels != np.arange(len(nodes)))
        a, b = nodes[moved], nodes[labels[moved]]

    for batch in batches:
        waiting.append(batch)
        if sum(w.num_rows for w in waiting) >= HELD:
            fold()
    fold()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, keep, held: int = HELD) -> DataFrame:
    """``a, b`` for every node ``a`` of ``links(a, b)`` that is not its component's smallest node ``b``.

    Null-free integer nodes; loops and repeated links do no harm; no links give no rows. ``keep`` writes a table to
    shared storage and reads it back. A task is given ``held`` links; once one task has contracted all that is left,
    or a round changes nothing, the stars are the components.
    """
    links = keep(links.where("a <> b"))
    seen = None
    while True:
        tasks = -(-links.count() // held)
        links = keep(links.coalesce(max(1, tasks)).mapInArrow(_contract, "a long, b long"))
        if tasks <= 1:
            return links
        mark = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            return links
        seen = mark
        links = keep(_small(keep(_large(links))))
