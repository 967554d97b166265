"""The stored text index against plain scans of the texts."""

import math
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from creaseline.operators import search, textindex
from creaseline.operators.search import edits_allowed
from creaseline.plans import search as plans
from creaseline.plans.registry import QUERIES


def words(text):
    return [] if text is None else text.lower().split()


def made_texts(n=400, seed=5):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "bat", "ball", "over", "wicket", "rare"] + [f"w{i}" for i in range(40)]
    weights = [300, 200, 50, 40, 20, 10, 1] + [2] * 40
    rows = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 60)))) for i in range(n)]
    # copies, nulls, empty and very long texts
    rows += [(n, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, "the of " * 5000), (n + 4, "wicket " * 30)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made_texts()


@pytest.fixture(scope="module")
def index(spark, rows):
    return textindex.build(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text", bits=3)


def ranking(rows, query):
    texts = {d: words(t) for d, t in rows}
    sized = [len(words(t)) for _, t in rows if t is not None]
    average, n = sum(sized) / len(sized), len(rows)
    out = {}
    for t in query:
        df = sum(t in w for w in texts.values())
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for d, w in texts.items():
            f = w.count(t)
            if f:
                out[d] = out.get(d, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / average))
    return out


@pytest.mark.parametrize("query", [["the"], ["rare", "of"], ["wicket", "ball", "the"], ["bat", "bat", "over"], ["absent", "over"], ["absent"]])
def test_scores_and_every_top_k(index, rows, query):
    expected = ranking(rows, query)
    got = {r["doc_id"]: r["score"] for r in textindex.bm25(index, query).collect()}
    assert got == pytest.approx(expected)
    full = sorted(got, key=lambda d: (-got[d], d))
    for k in (1, 7, 50, 1000):
        assert [r["doc_id"] for r in textindex.bm25_top(index, query, k).collect()] == full[:k]


def needed(index, query, k):
    idf = textindex.weights(index, query)
    scores = sorted((r["score"] for r in textindex.bm25(index, query).collect()), reverse=True)
    ranges = textindex.needed_blocks(index, idf, scores[k - 1])
    return {r[0]: textindex._ranges(index, [r]).count() for r in ranges}


def test_top_k_reads_few_blocks(index):
    read = needed(index, ["the"], 5)
    assert 5 <= read["the"] < 0.2 * textindex.document_counts(index, ["the"])["the"]
    # nothing that holds only the frequent term gets in, but what holds both needs all its postings
    read, held = needed(index, ["wicket", "the"], 5), textindex.document_counts(index, ["wicket", "the"])
    assert read["wicket"] < held["wicket"] and read["the"] == held["the"]


def test_blocks_bound_their_postings(index):
    held = index.postings.groupBy("term", "block").count()
    assert held.where("count > 8").count() == 0
    one = textindex.impact(F.col("frequency"), F.col("dl"), index.avgdl)
    assert index.postings.join(index.blocks, ["term", "block"]).where(one > F.col("impact")).count() == 0
    assert index.blocks.agg({"n": "sum"}).first()[0] == index.postings.count()


@pytest.mark.parametrize("phrase", [["the"], ["of", "the"], ["the", "the"], ["the", "of", "the"], ["bat", "the", "ball"], ["wicket", "wicket", "wicket"], ["the", "absent"]])
def test_phrases(index, rows, phrase):
    padded = f" {' '.join(phrase)} "
    expected = [d for d, t in rows if padded in f" {' '.join(words(t))} "]
    got = sorted(r["doc_id"] for r in textindex.match_phrase(index, phrase).collect())
    assert got == expected


def test_sorted_parts_grow_in_number_not_in_size(spark, rows, monkeypatch):
    """A part of the sort is bounded whatever the session's partitions, so that more texts spill no more rows."""
    monkeypatch.setattr(textindex, "SORTED_ROWS", 500)
    index = textindex.build(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text", bits=3)
    parts = [r["count"] for r in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert len(parts) > int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < 3 * 500
    assert sum(parts) == sum(len(set(words(t))) for _, t in rows)


def test_postings_of_odd_texts(spark, monkeypatch):
    """Words of ASCII bytes, none over the edge of two texts, in slices of any size."""
    texts = ["ab", "AB_1 ab", None, "", "é\u212aab\u0130 x", " ,", "last", "First\nlast \U0001f600a", "x" * 200 + " x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    listed = {r["id"]: r["w"] for r in df.select("id", search.tokens(F.col("t")).alias("w")).collect()}
    for size in (1 << 20, 20):
        monkeypatch.setattr(search, "SLICE_BYTES", size)
        found = search.postings(df, "t", "id").collect()
        assert {r["id"]: r["dl"] for r in found if r["term"] is None} == {i: None if w is None else len(w) for i, w in listed.items()}
        got = {(r["id"], r["term"]): (r["frequency"], r["positions"]) for r in found if r["term"] is not None}
        wanted = {}
        for i, w in listed.items():
            for place, term in enumerate(w or []):
                wanted.setdefault((i, term), []).append(place)
        assert got == {k: (len(p), p) for k, p in wanted.items()} and len(found) == len(got) + len(texts)


def test_match_counts_distinct_terms(index, rows):
    query = ["rare", "wicket", "wicket", "absent"]
    expected = {d: len(set(words(t)) & set(query)) for d, t in rows if set(words(t)) & set(query)}
    assert {r["doc_id"]: r["matched"] for r in textindex.match(index, query).collect()} == expected


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_terms_are_those_within_the_distance(spark):
    draw = random.Random(9)
    stems = ["a", "ab", "bat", "balls", "wicket", "boundary", "overthrow", "x" * 39, "long" * 10, "long" * 10 + "er", "q" * 60]
    terms = set(stems)
    for stem in stems:
        for _ in range(40):
            word = list(stem)
            for _ in range(draw.randint(1, 3)):
                place, what = draw.randrange(len(word) + 1), draw.choice("aeixq")
                word[place : place + draw.randint(0, 1)] = draw.choice([[], [what]])
            terms.add("".join(word) or "z")
    listed = sorted(terms)
    query = [*stems, "bats", "wickte", "long" * 10 + "e"]
    index = textindex.build(spark.createDataFrame(list(enumerate(listed)), "id int, t string"), "id", "t", fuzzy=True)
    got = Counter((r["q"], r["term"]) for r in textindex.near_terms(index, query).collect())
    expected = {(q, t) for q, w in enumerate(query) for t in listed if distance(w, t) <= edits_allowed(w)}
    assert got == Counter(expected)
    scores = {r["id"]: r["score"] for r in textindex.multi_match([(index, 2.0)], query).collect()}
    assert scores == {listed.index(t): 2.0 * n for t, n in Counter(t for _, t in expected).items()}


def test_suggestions_of_every_prefix(spark):
    draw = random.Random(4)
    names = [None, "", "Red Bolt"] + ["".join(draw.choices("aAbB ", k=draw.randint(1, 6))) for _ in range(300)]
    stored = search.completions(spark.createDataFrame([(n,) for n in names], "label string"), "label", size=4)
    got = {}
    for r in stored.orderBy("prefix", "number").collect():
        got.setdefault(r["prefix"], []).append(r["name"])
    known = sorted({n for n in names if n is not None})
    prefixes = {n.lower()[:i] for n in known for i in range(len(n) + 1)}
    assert got == {p: [n for n in known if n.lower().startswith(p)][:4] for p in prefixes}
    assert [r["name"] for r in search.suggestions(stored, "RED").collect()] == ["Red Bolt"]
    assert search.suggestions(stored, "redder").count() == 0


def test_empty_table(spark):
    index = textindex.build(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text", fuzzy=True)
    assert textindex.bm25(index, ["a"]).count() == textindex.bm25_top(index, ["a"], 3).count() == 0
    assert textindex.match_phrase(index, ["a", "b"]).count() == textindex.multi_match([(index, 1.0)], ["abc"]).count() == 0


@pytest.mark.parametrize("key", ["t2_term_postings", "t3_match", "t3_match_phrase", "t5_bm25", "t5_bm25_top", "t4_multi_field_match"])
def test_searches_read_no_texts(spark, data, key):
    """Every scan is one of the index, and those for given terms hand them to the files."""
    plan = QUERIES[key](spark, data)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any(f"{data}/" in line for line in scans)
    if key != "t4_multi_field_match":
        assert all("term" in line.partition("PushedFilters:")[2].partition("ReadSchema")[0] for line in scans)


def test_the_index_is_kept_until_the_files_change(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    write([(1, "a bat")])
    first = plans.documents_index(spark, str(tmp_path))
    assert plans.documents_index(spark, str(tmp_path)) is first
    assert first.kept() and not replace(first, folder=f"{tmp_path}/gone").kept()
    write([(1, "a bat"), (2, "a ball")])
    assert textindex.match(plans.documents_index(spark, str(tmp_path)), ["ball"]).count() == 1
