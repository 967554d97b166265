"""Quality classifier: gradient-boosted trees over statistics of a document.

Statistics are binned, and a tree's splits are found on histograms of gradients. Trees are complete, so the
model is four flat arrays and a batch of documents walks all of them with a few numpy steps a level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices, texts
from creaseline.llm.quality_rules import text_stats

FIT_ROWS = 40_000  # labelled rows that the trees are fitted on, at most
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 150, 4, 64, 0.1, 5.0, 20.0

#: Frequent short words of English, German, French and Spanish.
COMMON = frozenset(
    b"the of and to in is that it was for der die das und ist nicht ein zu mit den "
    b"le la les de des et en du que pour el los las y un por se no con".split()
)
SIGNS = b"#*$%&|<>{}[]()@/\\=_~^+-.,;:!?\"'"
FEATURES = 29


def statistics(several: list[str]) -> np.ndarray:
    """One row of FEATURES numbers for each text; all finite, also for an empty text."""
    out = np.zeros((len(several), FEATURES), np.float32)
    counted = np.array(text_stats(several), np.float64)
    for i, text in enumerate(several):
        raw = text.encode()
        n = max(1, len(raw))
        each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.split()
        many = max(1, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        line = np.array([len(x) for x in lines] or [0])
        share = each[each > 0] / n
        stops = each[list(b".!?")].sum()
        out[i] = [
            np.log1p(len(raw)),
            np.log1p(len(words)),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            len(set(words)) / many,
            sum(map(COMMON.__contains__, words)) / many,
            each[list(b".,;:!?")].sum() / many,
            counted[4, i] / many,
            counted[3, i] / max(1, len(lines)),
            np.log1p(len(lines)),
            np.log1p(line.mean()),
            np.log1p(line.std()),
            sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
            counted[2, i] / many,
            each[48:58].sum() / n,
            each[65:91].sum() / n,
            each[97:123].sum() / n,
            each[128:].sum() / n,
            each[list(SIGNS)].sum() / n,
            each[list(b"#*$%&|<>")].sum() / n,
            each[list(b"|")].sum() / n,
            each[list(b"&*#$%")].sum() / n,
            each[list(b"{}[]<>=/\\_")].sum() / n,
            each[10] / n,
            many / max(1, stops + 1),
            float(-(share * np.log2(share)).sum()),
            len(zlib.compress(raw, 1)) / n,
            float((each > 0).sum()),
        ]
    return out


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x array<float>`` of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = statistics(batch.column("text").to_pylist())
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * FEATURES), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, x array<float>")


class Trees:
    """Flat arrays: for each tree and inner node a feature and a threshold, for each tree and leaf a value."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1 if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted log-loss. Without rows, or with one label only, every score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    wide = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(wide)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(wide)], axis=1)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # within its level
        for level in range(depth):
            count, first = 1 << level, (1 << level) - 1
            cells = count * BINS
            g = np.stack([np.bincount(node * BINS + bins[:, f], gradient, cells) for f in range(wide)]).reshape(wide, count, BINS)
            h = np.stack([np.bincount(node * BINS + bins[:, f], weight, cells) for f in range(wide)]).reshape(wide, count, BINS)
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            least = LEAST * float(weight.mean())
            gain[(hl < least) | (ht - hl < least)] = 0
            for f in range(wide):
                gain[f, :, len(edges[f]) :] = 0
            best = gain.transpose(1, 0, 2).reshape(count, -1)
            pick = best.argmax(axis=1)
            f, b = pick // (BINS - 1), pick % (BINS - 1)
            split = best[np.arange(count), pick] > 1e-9
            for k in np.flatnonzero(split):
                feature[t, first + k], threshold[t, first + k] = f[k], edges[f[k]][b[k]]
            node = 2 * node + (split[node] & (bins[np.arange(len(y)), f[node]] > b[node]))
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        leaf[t] = RATE * g / (h + RIDGE)
        total += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def held_out() -> F.Column:
    """One document in five, by its id, is kept from fitting."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, keep, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score`` of every row of ``docs``; ``labels(doc_id, quality)`` teaches.

    Only labelled rows that are not held out teach, at most about ``fit_rows`` of them, taken by a hash of their ids.
    Rows without a label or id do not teach; a document with several labels counts once for each. The statistics see
    the text alone. ``keep`` writes a table to shared storage and reads it back.
    """
    spark = docs.sparkSession
    known = keep(features(docs))
    teaching = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y")).where(~held_out())
    rows = teaching.count()
    if rows > fit_rows:
        teaching = teaching.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / rows))
    sample = known.join(teaching, "doc_id").orderBy("doc_id").toArrow()
    x = sample["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    model = fit(x, sample["y"].to_numpy().astype(np.float64))
    # plain arrays: executors need no class of this package to read them
    arrays = spark.sparkContext.broadcast((model.base, model.feature, model.threshold, model.leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*arrays.value)
        for batch in batches:
            own = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(own))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = known.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score")
