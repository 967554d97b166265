"""From raw documents to token ids: five stages, each over all that the one before it kept.

A row is judged by itself: it is known by its doc_id, language and text, so rows that share or lack an id do not answer
for each other. Columns beside those of ``documents`` pass through unchanged until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from creaseline.llm import decontaminate, pieces, quality_rules, simhash, suffix_dedup
from creaseline.llm.common import table
from creaseline.llm.queries import tokenizer
from creaseline.session import materialize, prepare, shared_folder

#: No SQL: perplexity, XXH64 and the tokenizer have none. Tests hold the stages against brute force.
ORACLE_SQL = None


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``doc_id`` that tells rows apart unless they are equal in id, language and text. It sorts as the
    id does, null last."""
    text = F.coalesce("text", F.lit(""))
    own = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("digest"), F.char_length(text).alias("size")]
    return docs.withColumn("doc_id", F.struct(*own, F.col("lang").alias("lang")))


def _only(docs: DataFrame, ids: DataFrame, how: str, hint: str | None = None) -> DataFrame:
    """The rows of a named table whose name is listed (``left_semi``) or not (``left_anti``). The list is written first,
    so that Spark knows whether it is small."""
    listed = materialize(ids.select(F.col("doc_id").alias("__listed")).distinct())
    return docs.join(listed.hint(hint) if hint else listed, docs["doc_id"] == listed["__listed"], how)


def _without(docs: DataFrame, ids: DataFrame, hint: str | None = None) -> DataFrame:
    """The rows of a named table whose name is not listed, under their own ids."""
    return _only(docs, ids, "left_anti", hint).withColumn("doc_id", F.col("doc_id.id"))


def _packed(df: DataFrame) -> DataFrame:
    """Written once and read back, packed harder than usual: the table holds texts and stays while the stages run."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules or leave their language's perplexity band go."""
    kept = quality_rules.quality_rules(docs, _packed, carry=True).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("record").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays: one with the smallest doc_id, null being the largest."""
    named = _named(docs)
    found = materialize(simhash.near_duplicates(named, materialize))
    first = F.col("doc_id") == F.col("component_id")
    # equal rows are few; only they are put side by side
    again = materialize(found.where(first).groupBy("doc_id").count().where("count > 1"))
    # the list of copies grows with the corpus, so both sides are shuffled at every size
    once = _without(named, found.where(~first).select("doc_id").unionByName(again.select("doc_id")), "merge")
    several = _only(named, again, "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*[f"`{c.replace('`', '``')}`" for c in docs.columns])))
    one = several.withColumn("__number", F.row_number().over(order)).where("__number = 1").drop("__number")
    return once.unionByName(one.withColumn("doc_id", F.col("doc_id.id")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that start earlier in the corpus leave their text; a document that loses all its words goes. A
    null text becomes an empty one."""
    kept = suffix_dedup.remove_repeats(docs, carry=True).where((F.size("spans") == 0) | (F.trim("rest") != ""))
    now = {"text": F.col("rest")}
    if "n_chars" in docs.columns:
        length = F.char_length("rest").cast(docs.schema["n_chars"].dataType)
        now["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("record.n_chars"))
    return kept.select(*[now.get(c, F.col("record").getField(c)).alias(c) for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its error budget, go."""
    docs = _named(docs)
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), short=True))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every remaining document."""
    out = pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model"))
    return pieces.digests(out, "ids")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_free),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, a written table between one and the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
