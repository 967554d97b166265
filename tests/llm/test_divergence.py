import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F, types as T

from creaseline.llm import divergence
from creaseline.llm.queries import QUERIES

ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "source")])
CAPITALS = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


def plain(rows, least=3, top=200):
    docs, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        own = split(text)
        docs[lang or ""].update(set(own))
        counts[lang or "", source or ""].update(own)
    for lang in {g for g, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept if c[t]} for (g, s), c in counts.items() if g == lang}
        whole = Counter()
        for own in groups.values():
            whole.update(own)

        def shares(own):
            total = sum(own.values())
            return {t: 1 + 10**9 * (own.get(t, 0) + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(own) for s, own in groups.items()}
        q = shares(whole)
        for s, own in groups.items():
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            more = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own.get(t) and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def collected(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows, partitions=3: spark.createDataFrame(rows, ROW).repartition(partitions)


def test_query_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("text", "lang", "source").collect()]
    assert collected(QUERIES["op11_divergence"](spark, data)) == plain(rows)


def test_random_rows(table, keep):
    rng = random.Random(3)
    words = ["a", "B", "ab", "abc", "abcd", "abcde", "Abcdefgh", "abcdefghi", "é", "ÉÉ", "日本語日本語日本語", "x" * 40 + "y", "x" * 40 + "z", "x" * 90, "naïve", "zz"]
    rows = [(" 1-_".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, "S", "é"])) for _ in range(120)]
    assert collected(divergence.divergence(table(rows), keep)) == plain(rows)
    assert collected(divergence.divergence(table(rows), keep, least=20, top=2)) == plain(rows, 20, 2)


def test_prefixes_that_many_hold_but_no_term_is_kept(table, keep):
    """Every document has the same first bytes in a word of its own; one shares a long term with two others."""
    long = "prefix" * 30
    rows = [(f"{long}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", "en", f"s{i % 4}") for i in range(60)]
    rows += [(long + "end", "en", "s1")] * 2 + [(long.upper() + "END", "en", "s9"), ("lone", "fr", "s1"), (None, "fr", "s2"), ("", None, None)]
    assert collected(divergence.divergence(table(rows), keep)) == plain(rows)


def test_levels_end_with_the_kept_terms(table, keep):
    rows = [("abcdefghijk ab abcd", "en", "s")] * 3 + [("abcdefghzz q", "en", "t")] * 2
    levels = []

    def noted(df):
        out = keep(df)
        if out.columns == ["lang", "prefix", "docs"]:
            levels.append(sorted((bytes(r.prefix).decode(), r.docs) for r in out.collect()))
        return out

    kept = divergence.kept_terms(table(rows), noted)
    assert levels[:3] == [[("ab", 3), ("abcd", 5)], [("abcd", 3), ("abcdefgh", 5)], [("abcdefghijk", 3)]]
    assert sorted((bytes(r.prefix).decode(), r.docs) for r in kept.collect()) == [("ab", 3), ("abcd", 3), ("abcdefghijk", 3)]


def test_counts_fold_in_parts(table, keep, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2)
    rows = [(f"w{chr(97 + i % 20)} x{chr(97 + i % 7)} common", "en", f"s{i % 3}") for i in range(200)]
    assert collected(divergence.divergence(table(rows), keep)) == plain(rows)


def test_many_blocks(table, keep, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 8)
    rng = random.Random(8)
    rows = [(" ".join(rng.choices([a + b for a in "abcdef" for b in "ghijkl"], k=12)), "en", f"s{rng.randint(0, 4)}") for _ in range(80)]
    assert collected(divergence.divergence(table(rows), keep)) == plain(rows)


def test_share_is_exact_for_large_counts(spark):
    rows = [(0, 0, 1), (10**15, 10**15, 7), (9 * 10**18, 9 * 10**18, 10**9), (3, 10**18 + 1, 999_999_937)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]


def test_empty_table_and_clashing_columns(table, keep, spark):
    assert divergence.divergence(spark.createDataFrame([], ROW), keep).collect() == []
    rows = [("one two", "en", s) for s in "abcd"] + [("two", "en", "a"), ("three " * 100_000, "en", "b")]
    names = ["term", "prefix", "docs", "n", "p", "q", "block", "total", "vocabulary", "rank", "value", "item"]
    assert collected(divergence.divergence(table(rows).select("*", *[F.lit("clash").alias(n) for n in names]), keep)) == plain(rows)
