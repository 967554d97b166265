"""A stored text index: postings in blocks with bounds, and the searches that read it instead of the texts.

Tables of an index, each written once:

``lengths``   one row per document: ``doc``, ``dl`` (number of words; null for a null text)
``postings``  ``term, doc, frequency, dl, positions, block``, in the order of term and falling impact, so that a filter on
              term and block skips files and pages
``blocks``    one row per (term, block): ``n`` postings and their highest ``impact``
``terms``     the dictionary: ``term``, ``length`` in characters, ``df`` documents
``near``      only with ``fuzzy``: digests of what up to two deletions leave of each term of the dictionary

A block is at most ``2 ** bits`` neighbouring postings of one term, so a frequent term has many and no row or group grows
with the corpus. What reaches the driver is bounded by the query: a few numbers per query word and up to k block bounds
per query word of a top-k. Document ids are taken to be unique.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from math import log
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from creaseline.operators.search import B, K1, edits_allowed, postings
from creaseline.session import materialize, shared_folder

#: Terms up to this length are found by deletions (at most about 800 a term); longer ones are compared one by one.
LONG = 40
#: Bounds and scores are sums of doubles; a block is skipped only if it stays this far below the threshold.
SLACK = 1e-9
#: Postings that a task sorts, some 100 bytes each.
SORTED_ROWS = 2_000_000


@dataclass(frozen=True)
class TextIndex:
    doc: str
    folder: str
    lengths: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    near: DataFrame | None = None

    def kept(self) -> bool:
        """Whether the tables are still there; whoever cleans the shared folder need not know of indexes."""
        names = ["analysed", "postings", "blocks", "terms"] + (["near"] if self.near else [])
        try:
            self.terms.sparkSession.read.schema("term string").parquet(*[f"{self.folder}/{n}" for n in names])
        except AnalysisException:
            return False
        return True


def impact(frequency: Column, dl: Column, avgdl: float) -> Column:
    """BM25 of one term without its idf: rises with the frequency, falls with the length."""
    return frequency * (K1 + 1) / (frequency + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.lit(avgdl)))


def build(df: DataFrame, doc: str, text: str, fuzzy: bool = False, bits: int = 10) -> TextIndex:
    """Index of a text column. Texts are analysed once, dealt evenly over the session's shuffle partitions, whatever the
    files they come from; a document without words counts in the statistics and has no postings."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartition(tasks, "doc")
    analysed = materialize(postings(dealt, "text", "doc"), f"{folder}/analysed")
    lengths = analysed.where("term IS NULL").select("doc", "dl")
    own = F.when(F.col("term").isNull(), F.col("dl"))
    size = analysed.agg(F.count_if(F.col("term").isNull()).alias("n"), F.avg(own).alias("avgdl"), F.count("term").alias("postings")).first()
    avgdl = size["avgdl"] or 1.0
    rows = analysed.where("term IS NOT NULL").select("term", "frequency", "positions", "doc", "dl")
    order = ["term", F.desc("impact"), "doc"]
    weighed = rows.withColumn("impact", impact(F.col("frequency"), F.col("dl"), avgdl))
    # a sort of more rows than a task's memory holds would be written and read once more
    needed = size["postings"] // SORTED_ROWS + 1
    ranged = weighed.repartitionByRange(needed, *order) if needed > tasks else weighed.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order)
    # ids count up within a partition, so a shifted id numbers runs of neighbouring rows
    block = F.shiftright(F.monotonically_increasing_id(), bits).alias("block")
    stored = materialize(placed.select("term", "doc", "frequency", "dl", "positions", block), f"{folder}/postings")
    # highest frequency and shortest document apart would bound a block of equal impacts far too high
    highest = F.max(impact(F.col("frequency"), F.col("dl"), avgdl)).alias("impact")
    bounds = stored.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), highest)
    blocks = materialize(bounds.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), f"{folder}/blocks")
    counted = blocks.groupBy("term").agg(F.sum("n").alias("df")).withColumn("length", F.char_length("term"))
    terms = materialize(counted.repartitionByRange("length", "term").sortWithinPartitions("length", "term"), f"{folder}/terms")
    near = neighbourhood(terms, f"{folder}/near") if fuzzy else None
    return TextIndex(doc, folder, lengths, stored, blocks, terms, size["n"], avgdl, near)


def of_terms(rows: DataFrame, query: list[str]) -> DataFrame:
    """The rows of the query's terms; the filter reaches the files."""
    return rows.where(F.col("term").isin(sorted(set(query))))


def document_counts(index: TextIndex, query: list[str]) -> dict[str, int]:
    """Documents per query term, 0 for a term of none: one number per query word."""
    found = of_terms(index.blocks, query).groupBy("term").agg(F.sum("n").alias("df")).collect()
    return dict.fromkeys(query, 0) | {r["term"]: r["df"] for r in found}


def match(index: TextIndex, query: list[str]) -> DataFrame:
    """Documents that share a term with the query, with the number of distinct terms shared."""
    hits = of_terms(index.postings, query).groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("matched"))
    return hits.withColumnRenamed("doc", index.doc)


def match_phrase(index: TextIndex, phrase: list[str]) -> DataFrame:
    """Documents with the terms of the phrase at consecutive positions: from the rarest term on, the places where the
    phrase could start are intersected document by document."""
    if not phrase:
        raise ValueError("a phrase has at least one term")
    count = document_counts(index, phrase)
    offsets = sorted(range(len(phrase)), key=lambda i: (count[phrase[i]], i))

    def starts(offset: int, name: str) -> DataFrame:
        places = F.transform("positions", lambda p: p - offset)
        return index.postings.where(F.col("term") == phrase[offset]).select("doc", places.alias(name))

    found = starts(offsets[0], "starts")
    for offset in offsets[1:]:
        both = found.join(starts(offset, "others"), "doc")
        found = both.select("doc", F.array_intersect("starts", "others").alias("starts")).where(F.size("starts") > 0)
    return found.select(F.col("doc").alias(index.doc))


def weights(index: TextIndex, query: list[str]) -> dict[str, float]:
    """idf of each distinct query term, as often as the query says it."""
    count = document_counts(index, query)
    return {t: times * log(1 + (index.n - count[t] + 0.5) / (count[t] + 0.5)) for t, times in Counter(query).items()}


def scored(index: TextIndex, rows: DataFrame, idf: dict[str, float]) -> DataFrame:
    """BM25 of the documents of some postings. Terms are added in the query's order, so equal documents score alike."""
    one = impact(F.col("frequency"), F.col("dl"), index.avgdl)
    parts = [F.sum(F.when(F.col("term") == t, one * F.lit(w))).alias(f"s{i}") for i, (t, w) in enumerate(idf.items())]
    total = reduce(lambda a, b: a + b, [F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(idf))])
    return rows.groupBy("doc").agg(*parts).select("doc", total.alias("score"))


def bm25(index: TextIndex, query: list[str]) -> DataFrame:
    """BM25 of every document that holds a query term."""
    found = scored(index, of_terms(index.postings, query), weights(index, query))
    return found.withColumnRenamed("doc", index.doc)


def bm25_top(index: TextIndex, query: list[str], k: int) -> DataFrame:
    """The k best of ``bm25``, ties by document id, from the blocks that can hold one of them.

    The first blocks of each term give k documents a lower bound; the k-th of these is the threshold. A block is needed
    only if its bound and the best of all other terms together reach it: a document in any other block stays below, and
    so does the part of its score that other blocks may give. Each term's needed blocks are read as one range. Beside a
    much rarer term a frequent one is read whole: its weight is small, but any document of the rare term may hold it.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    idf = weights(index, query)
    first = []
    for term in idf:
        held, ids = 0, []
        for row in index.blocks.where(F.col("term") == term).orderBy("block").limit(k).select("block", "n").collect():
            held, ids = held + row["n"], [*ids, row["block"]]
            if held >= k:
                break
        if ids:
            first.append((term, ids[0], ids[-1]))
    best = scored(index, _ranges(index, first), idf).orderBy(F.desc("score")).limit(k)
    least = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
    threshold = least["score"] if least["n"] == k else 0.0
    found = scored(index, _ranges(index, needed_blocks(index, idf, threshold)), idf)
    return found.orderBy(F.desc("score"), "doc").limit(k).withColumnRenamed("doc", index.doc)


def needed_blocks(index: TextIndex, idf: dict[str, float], threshold: float) -> list[tuple[str, int, int]]:
    """First and last block of each term that can hold a document of at least the threshold."""
    own = of_terms(index.blocks, list(idf))
    weight = reduce(lambda c, t: c.when(F.col("term") == t, F.lit(idf[t])), list(idf), F.when(F.lit(False), F.lit(0.0)))
    bounded = own.select("term", "block", (F.col("impact") * weight).alias("bound"))
    best = {r["term"]: r["bound"] for r in bounded.groupBy("term").agg(F.max("bound").alias("bound")).collect()}
    reach = [(F.col("term") == t) & (F.col("bound") + F.lit(sum(best.values()) - best[t]) >= threshold - SLACK) for t in best]
    if not reach:
        return []
    rows = bounded.where(reduce(or_, reach)).groupBy("term").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    return [(r["term"], r["low"], r["high"]) for r in rows.collect()]


def _ranges(index: TextIndex, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Postings of ranges of blocks, one range a term; the filter reaches the files."""
    if not ranges:
        return index.postings.where(F.lit(False))
    return index.postings.where(reduce(or_, [(F.col("term") == t) & F.col("block").between(low, high) for t, low, high in ranges]))


def _shortened(word: Column) -> Column:
    """What one deletion leaves of a word, for each place."""
    places = F.sequence(F.lit(1), F.char_length(word))
    return F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def neighbourhood(terms: DataFrame, folder: str) -> DataFrame:
    """``length, deletions, key, term``: digests of what 0, 1 and 2 deletions leave of each term up to ``LONG`` characters."""
    short = terms.where(F.col("length") <= LONG).select("length", "term", F.array("term").alias("d0"))
    once = short.withColumn("d1", F.array_distinct(_shortened(F.col("term"))))
    twice = once.withColumn("d2", F.array_distinct(F.flatten(F.transform("d1", lambda w: _shortened(w)))))

    def level(deletions: int) -> Column:
        return F.transform(f"d{deletions}", lambda w: F.struct(F.lit(deletions).alias("deletions"), F.xxhash64(w).alias("key")))

    levels = [level(i) for i in range(3)]
    rows = twice.select("length", "term", F.explode(F.concat(*levels)).alias("v")).select("length", "v.*", "term")
    return materialize(rows.repartitionByRange("length", "key").sortWithinPartitions("length", "key"), folder)


def _deleted(word: str, most: int) -> set[str]:
    level = found = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found = found | level
    return found


def near_terms(index: TextIndex, query: list[str]) -> DataFrame:
    """``q, term``: the terms of the dictionary within the edit distance that the length of the q-th query word allows.

    Two words within d edits share what at most d deletions leave of each, so candidates meet by digest; the distance is
    computed once per candidate term. Terms over ``LONG`` characters of a fitting length are all compared.
    """
    if index.near is None:
        raise ValueError("build the index with fuzzy=True")
    spark = index.terms.sparkSession
    asked = [(q, w, edits_allowed(w)) for q, w in enumerate(query)]
    found = spark.createDataFrame([], "q int, term string")
    lookups = [(q, w, d, v) for q, w, d in asked if len(w) - d <= LONG for v in _deleted(w, d)]
    if lookups:
        keys = spark.createDataFrame(lookups, "q int, word string, most int, variant string").withColumn("key", F.xxhash64("variant"))
        low, high = min(len(w) - d for _, w, d, _ in lookups), max(len(w) + d for _, w, d, _ in lookups)
        stored = index.near.where(F.col("length").between(low, high) & (F.col("deletions") <= max(d for _, _, d, _ in lookups)))
        met = stored.join(keys.drop("variant"), "key").where("deletions <= most").select("q", "word", "most", "term").distinct()
        found = met.where(F.levenshtein("term", "word") <= F.col("most")).select("q", "term")
    for q, w, d in asked:
        if len(w) + d > LONG:
            fitting = index.terms.where(F.col("length").between(max(LONG + 1, len(w) - d), len(w) + d))
            found = found.unionByName(fitting.where(F.levenshtein("term", F.lit(w), d) >= 0).select(F.lit(q).alias("q"), "term"))
    return found


def multi_match(fields: list[tuple[TextIndex, float]], query: list[str]) -> DataFrame:
    """Documents with a near term, scored by their best field: its boost times the query words found there."""

    def field(index: TextIndex, boost: float) -> DataFrame:
        hits = index.postings.select("term", "doc").join(materialize(near_terms(index, query)), "term")
        return hits.groupBy("doc").agg((F.count_distinct("q") * F.lit(float(boost))).alias("score"))

    best = reduce(DataFrame.unionByName, [field(*f) for f in fields]).groupBy("doc").agg(F.max("score").alias("score"))
    return best.withColumnRenamed("doc", fields[0][0].doc)
