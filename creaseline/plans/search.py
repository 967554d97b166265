"""T: text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from creaseline.operators import search, textindex
from creaseline.plans.registry import query
from creaseline.sources.tables import table, texts


def tokens_sql(text: str) -> str:
    return (
        rf"list_transform(list_filter(regexp_split_to_array({text}, '[^\w]+'), lambda x: x <> ''), lambda x: lower(x))"
    )


def html_sql(html: str) -> str:
    for pattern, replacement in search.HTML_RULES:
        new = "chr(10)" if replacement == "\n" else f"'{replacement}'"
        html = f"regexp_replace({html}, '{pattern}', {new}, 'g')"
    for entity, char in search.ENTITIES.items():
        html = f"replace({html}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')" if entity != "&#39;" else f"replace({html}, '&#39;', chr(39))"
    return html


def synonyms_sql(text: str, rules: dict[str, list[str]]) -> str:
    pairs = sorted(((alt, target) for target, alts in rules.items() for alt in alts), key=lambda p: (-len(p[0]), p[0]))
    for alternative, target in pairs:
        text = rf"regexp_replace({text}, '\b{alternative}\b', '{target}', 'g')"
    return text


PAGE_TEXT_SQL = f"replace(replace({html_sql('html')}, '&', 'and'), '@', 'at')"
_indexes: dict[tuple, textindex.TextIndex] = {}


def stored_index(spark, folder: str, name: str, doc: str, text: str, fuzzy: bool = False) -> textindex.TextIndex:
    """The index of a text column, built once per session and state of the table's files."""
    files = table(spark, folder, name).select(
        F.xxhash64("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").alias("file")
    )
    version = files.distinct().agg(F.bit_xor("file")).first()[0]
    key = (spark.sparkContext.applicationId, folder, name, version, doc, text, fuzzy)
    if key not in _indexes or not _indexes[key].kept():
        _indexes[key] = textindex.build(texts(spark, folder, name), doc, text, fuzzy)
    return _indexes[key]


def documents_index(spark, folder: str) -> textindex.TextIndex:
    return stored_index(spark, folder, "documents", "doc_id", "text")


RULES = {"widget": ["gizmo"], "roadster": ["hot rod"], "band": ["ring"]}
GROUPS = [["bolt", "rod", "small ring"]]


@query(
    "t1_analyzer",
    f"""WITH t AS (SELECT page_id, array_to_string({tokens_sql(PAGE_TEXT_SQL)}, ' ') AS joined FROM pages),
    s AS (SELECT page_id, {synonyms_sql('joined', search.SYNONYMS)} AS joined FROM t)
    SELECT page_id, array_to_string(list_filter(string_split(joined, ' '), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'and', 'or')), ' ') AS tokens FROM s""",
)
def analyzer(spark, folder):
    kept = search.analyze(F.col("html"))
    return texts(spark, folder, "pages").select("page_id", F.array_join(kept, " ").alias("tokens"))


@query(
    "t2_inverted_index",
    f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS words FROM documents),
    p AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos FROM t)
    SELECT term, doc_id, count(*) AS frequency, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM p GROUP BY 1, 2""",
)
def inverted_index(spark, folder):
    """Every posting of the stored index; its rows were analysed in parallel, whatever the files of the texts."""
    index = documents_index(spark, folder).postings.select("term", F.col("doc").alias("doc_id"), "frequency", "positions")
    return index.withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query(
    "t2_term_postings",
    f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS words FROM documents),
    p AS (SELECT doc_id, unnest(words) AS term FROM t)
    SELECT term, doc_id, count(*) AS frequency FROM p WHERE term = 'ening' GROUP BY 1, 2""",
)
def term_postings(spark, folder):
    """The index as a table in the order of its terms: a lookup skips the files of other terms, and a term of
    many documents fills several."""
    stored = documents_index(spark, folder).postings
    return stored.where("term = 'ening'").select("term", F.col("doc").alias("doc_id"), "frequency")


@query("t3_term", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def term(spark, folder):
    return table(spark, folder, "documents").where("lang = 'fr'").select("doc_id")


@query(
    "t3_match",
    f"""SELECT doc_id, CAST(len(list_distinct(list_filter({tokens_sql('text')}, lambda t: t IN ('ening', 'edre', 'tion')))) AS INTEGER) AS matched
    FROM documents WHERE matched > 0""",
)
def match(spark, folder):
    return textindex.match(documents_index(spark, folder), ["ening", "edre", "tion"])


@query(
    "t3_match_phrase",
    f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({tokens_sql('text')}, ' ') || ' ', ' of the ')",
)
def match_phrase(spark, folder):
    return textindex.match_phrase(documents_index(spark, folder), ["of", "the"])


def hits_sql(field: str, terms: list[str]) -> str:
    return " + ".join(
        f"CAST(len(list_filter({tokens_sql(field)}, lambda w: levenshtein(w, '{t}') <= {search.edits_allowed(t)})) > 0 AS INTEGER)"
        for t in terms
    )


@query(
    "t4_multi_field_match",
    f"""SELECT p_partkey, CAST(greatest(({hits_sql('p_name', ['blu', 'wigdet', 'standart'])}) * 2.0, ({hits_sql('p_type', ['blu', 'wigdet', 'standart'])}) * 1.0) AS DOUBLE) AS score
    FROM part WHERE score > 0""",
)
def multi_field_match(spark, folder):
    boosts = {"p_name": 2.0, "p_type": 1.0}
    fields = [(stored_index(spark, folder, "part", "p_partkey", f, fuzzy=True), boost) for f, boost in boosts.items()]
    return textindex.multi_match(fields, ["blu", "wigdet", "standart"])


BM25_TERMS = ["tion", "the", "ening"]


BM25_SQL = (
    f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS words FROM documents),
    c AS (SELECT doc_id, len(words) AS dl, """
    + ", ".join(f"len(list_filter(words, lambda w: w = '{q}')) AS tf{i}" for i, q in enumerate(BM25_TERMS))
    + """ FROM t),
    s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, """
    + ", ".join(f"count(*) FILTER (tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(BM25_TERMS)))
    + """ FROM c),
    r AS (SELECT doc_id, """
    + " + ".join(
        f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
        for i in range(len(BM25_TERMS))
    )
    + " AS score FROM c, s)"
)


@query("t5_bm25", f"{BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0")
def bm25(spark, folder):
    scored = textindex.bm25(documents_index(spark, folder), BM25_TERMS)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query("t5_bm25_top", f"{BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 10")
def bm25_top(spark, folder):
    """The ten best, from the blocks whose bounds reach the tenth of a first look."""
    best = textindex.bm25_top(documents_index(spark, folder), BM25_TERMS, 10)
    return best.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "t6_function_score",
    """SELECT p_partkey, round(CASE WHEN p_size > 40 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN p_size / 10.0::DOUBLE >= 4.5 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
    * exp(pow(greatest(abs(p_retailprice - 1000) - 10, 0), 2) * ln(0.5::DOUBLE) / 2500) * log10(1 + 0.1::DOUBLE * p_size), 6) AS score FROM part""",
)
def function_score(spark, folder):
    filters = [(F.col("p_size") > 40, 2.0), (F.col("p_size") / 10 >= 4.5, 1.5)]
    factors = [
        search.gauss_decay(F.col("p_retailprice"), 1000.0, 50.0, 10.0),
        search.log1p_factor(F.col("p_size"), 0.1),
    ]
    score = search.function_score(filters, factors)
    return table(spark, folder, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query(
    "t7_script_score",
    """WITH s AS (SELECT l_partkey, count(*) AS sales FROM lineitem GROUP BY 1)
    SELECT p_partkey, round((p_size / 10.0::DOUBLE * 10 + coalesce(ln(sales + 1) * 5, 0)) * CASE WHEN p_size % 7 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score
    FROM part LEFT JOIN s ON p_partkey = l_partkey""",
)
def script_score(spark, folder):
    sales = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("sales"))
    parts = table(spark, folder, "part").select("p_partkey", "p_size").join(sales, "p_partkey", "left")
    score = search.script_score(F.col("p_size") / 10, F.col("sales"), F.col("p_size") % 7)
    return parts.select("p_partkey", F.round(score, 6).alias("score"))


@query(
    "t8_highlight",
    r"""SELECT doc_id, regexp_replace(text, '(?i)\b(tion|the)\b', '<em>\1</em>', 'g') AS highlighted FROM documents""",
)
def highlight(spark, folder):
    return texts(spark, folder, "documents").select("doc_id", search.highlight(F.col("text"), ["tion", "the"]).alias("highlighted"))


@query("t9_prefix_suggestions", "SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 're') ORDER BY p_name LIMIT 10")
def prefix_suggestions(spark, folder):
    stored = search.completions(table(spark, folder, "part"), "p_name")
    return search.suggestions(stored, "Re").withColumnRenamed("name", "p_name")


CROSS_TERMS = ["red", "nation_7"]
CROSS_SQL = {
    "team": ("CAST(c_custkey AS VARCHAR)", "c_name", "customer"),
    "player": ("CAST(p_partkey AS VARCHAR)", "p_name", "part"),
    "venue": ("CAST(n_nationkey AS VARCHAR)", "n_name", "nation"),
    "title": ("CAST(o_orderkey AS VARCHAR)", "c_name || ' at ' || n_name", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
}


@query(
    "t10_cross_entity_search",
    "SELECT entity_type, entity_id, label, score FROM ("
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS entity_type, {key} AS entity_id, {label} AS label, CAST({hits_sql(label, CROSS_TERMS)} AS DOUBLE) AS score FROM {source}"
        for kind, (key, label, source) in CROSS_SQL.items()
    )
    + ") WHERE score > 0",
)
def cross_entity_search(spark, folder):
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    venues = nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # a title depends on the customer alone, so it is scored once per customer and then joined
    titles = customers.join(venues, "c_nationkey").select(
        "c_custkey", F.concat("c_name", F.lit(" at "), "n_name").alias("label")
    )
    scored = search.multi_match(titles, {"label": 1.0}, CROSS_TERMS)
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))

    def entity(kind: str, df: DataFrame, key: str, label: str) -> DataFrame:
        rows = df.select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.col(label).alias("label"))
        return search.multi_match(rows, {"label": 1.0}, CROSS_TERMS)

    hits = [
        entity("team", customers, "c_custkey", "c_name"),
        entity("player", table(spark, folder, "part"), "p_partkey", "p_name"),
        entity("venue", nations, "n_nationkey", "n_name"),
        orders.join(scored, "c_custkey").select(
            F.lit("title").alias("entity_type"), F.col("o_orderkey").cast("string").alias("entity_id"), "label", "score"
        ),
    ]
    return reduce(DataFrame.unionByName, hits)


@query(
    "t11_synonym_one_way",
    f"SELECT p_partkey, {synonyms_sql('lower(p_name)', RULES)} AS normalized FROM part",
)
def synonym_one_way(spark, folder):
    joined = F.array_join(search.tokens(F.col("p_name")), " ")
    return table(spark, folder, "part").select("p_partkey", search.replace_synonyms(joined, RULES).alias("normalized"))


@query(
    "t11_synonym_multi_way",
    """SELECT p_partkey, p_name FROM part WHERE contains(' ' || p_name || ' ', ' bolt ') OR contains(' ' || p_name || ' ', ' rod ')
    OR contains(' ' || p_name || ' ', ' small ring ')""",
)
def synonym_multi_way(spark, folder):
    phrases = search.expand("bolt", GROUPS)
    return search.match_any_phrase(table(spark, folder, "part"), "p_name", phrases).select("p_partkey", "p_name")
