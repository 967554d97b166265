"""The dealt operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from creaseline.llm import (
    decontaminate,
    divergence,
    fill_middle,
    html_text,
    pieces,
    quality_rules,
    quality_trees,
    shards,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_counts,
    warc,
)
from creaseline.llm.common import table
from creaseline.session import materialize, prepare, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
    return function


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.digests(pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model")))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json"), shared_folder(spark))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shards.write_shards(table(spark, sf_dir, "documents"), shared_folder(spark))
    text = F.coalesce("record.text", F.lit(""))
    return written.select(
        "record.doc_id",
        "size",
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), materialize)
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "lang", "loss", "lower", "upper")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = shared_folder(spark), table(spark, sf_dir, "pages")
    warc.build_index(warc.write_archives(pages, folder), folder)
    return warc.page_digests(warc.lookup(pages, folder), materialize)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this package

    return corpus_pipeline.run(spark, sf_dir)


_SHA1 = "sha1(coalesce(html, ''))"
_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, (i // 4) * 5 + 1, 5) as int) >> (15 - 5 * (i % 4))) & 31), 1)"

ORACLES["op10_warc"] = f"""
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, {_SHA1} as x from pages),
f as (select x, min(page_id) as m from p group by x)
select page_id, payload_bytes,
  array_to_string([{_BASE32} for i in [{", ".join(map(str, range(32)))}]], '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type,
  case when page_id = m then null else m end as refers_to
from p join f using (x)
"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), materialize)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


@query
def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality_trees.quality_scores(docs, labels, materialize)
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_DRAWN = ", ".join(f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint) as h{i + 1}" for i in range(4))

ORACLES["op12_fill_middle"] = f"""
with t as (
  select doc_id, coalesce(text, '') as x, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
d as (select doc_id, x, u, cast(len(u) as bigint) as n, {_DRAWN} from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (
  select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
select doc_id, n, form,
  case when form = 'plain' then null else length(pre) end as prefix_chars,
  case when form = 'plain' then null else length(mid) end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(x) as restored_sha256
from p
"""


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_passages(table(spark, sf_dir, "documents"), materialize))


ORACLES["op13_substring_dedup"] = """
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from t),
l as (
  select doc_id, i, word, count(*) over own as size,
    string_agg(word, ' ' order by i) over (partition by doc_id order by i rows between current row and 34 following) as seq
  from u window own as (partition by doc_id order by i rows between current row and 34 following)),
r as (select seq from l where size = 35 group by seq having count(*) > 1),
m as (select doc_id, i, word, size = 35 and seq in (select seq from r) as hit from l),
c as (
  select doc_id, i, word, max(cast(hit as int)) over (partition by doc_id order by i rows between 34 preceding and current row) = 1 as gone
  from m),
k as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as rest from c group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from documents left join k using (doc_id)
"""


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), materialize)


_SHARE = "1 + cast(1000000000 as hugeint) * ({n} + 1) // ({total} + v)"

ORACLES["op11_divergence"] = f"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
w as (select r, lang, source, unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from w group by all having count(distinct r) >= 3),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(term) as v, coalesce(sum(n), 0) as total from (select distinct lang from g) left join k using (lang) group by lang),
t as (select lang, source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by all),
p as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, cast({_SHARE.format(n="coalesce(c.n, 0)", total="t.total")} as bigint) as p,
    cast({_SHARE.format(n="k.n", total="v.total")} as bigint) as q
  from t join v using (lang) join k on k.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
f as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // q as bigint) as value from p where n > 0 and p > q),
ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
  from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 200
"""
