"""Skewed keys: the slotted computations equal the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from creaseline.operators.hotkeys import SLOT, paged_lists, previous, running, spread
from creaseline.operators.joins import salted


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = 0 if i % 3 == 0 else rng.randrange(1, 60)
        rows.append((key, rng.randrange(0, 50), i, rng.randrange(-5, 10)))
    return rows, spark.createDataFrame(rows, "k int, t int, id int, v int")


def by_key(rows):
    out = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(k, []).append((i, v))
    return out


def test_running(skewed, many_slots):
    rows, df = skewed
    tagged = spread(df, ["k"], ["t", "id"])
    got = {r.id: (r.n, r.s) for r in running(tagged, ["k"], ["t", "id"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    want = {}
    for values in by_key(rows).values():
        total = 0
        for n, (i, v) in enumerate(values, 1):
            total += v
            want[i] = (n, total)
    assert got == want


def test_previous(skewed, many_slots):
    rows, df = skewed
    tagged = spread(df, ["k"], ["t", "id"])
    got = {r.id: r.before for r in previous(tagged, ["k"], ["t", "id"], {"before": "v"}).collect()}
    want = {}
    for values in by_key(rows).values():
        last = None
        for i, v in values:
            want[i], last = last, v
    assert got == want


def test_slots_cut_a_heavy_key_and_follow_its_order(skewed, many_slots):
    _, df = skewed
    rows = spread(df, ["k"], ["t", "id"]).where("k = 0").orderBy("t", "id").collect()
    slots = [r[SLOT] for r in rows]
    assert slots == sorted(slots) and len(set(slots)) > 8
    assert max(slots.count(s) for s in set(slots)) < len(rows) / 5


def test_paged_lists_keep_everything(skewed, many_slots):
    rows, df = skewed
    pages = paged_lists(df, ["k"], ["t", "id"], F.col("id"), size=10).collect()
    assert all(len(p["items"]) <= 10 for p in pages)
    got = {}
    for p in sorted(pages, key=lambda p: (p["k"], p["page"])):
        got.setdefault(p["k"], []).extend(p["items"])
    assert got == {k: [i for i, _ in values] for k, values in by_key(rows).items()}


def test_salts_follow_the_rows_of_a_key(spark):
    left = spark.createDataFrame([(0, i) for i in range(95)] + [(1, 1), (2, 2)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (3, "d")], "k int, w string")
    spread_left, repeated = salted(left, right, "k", F.col("v"), rows=10)
    assert {r["k"]: r["n"] for r in spread_left.groupBy("k").agg(F.countDistinct("_salt").alias("n")).collect()} == {0: 10, 1: 1, 2: 1}
    assert {r["k"]: r["count"] for r in repeated.groupBy("k").count().collect()} == {0: 10, 1: 2}
    joined = spread_left.join(repeated, ["k", "_salt"]).drop("_salt")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
