import random

import pytest
from hypothesis import given, settings, strategies as st

from creaseline.llm import decontaminate
from creaseline.llm.decontaminate import Finder, Pattern, budget, cut, normal
from creaseline.llm.queries import QUERIES


def plain(item, text):
    """Smallest edit distance of ``item`` to a substring of ``text``, and where the first such match ends."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        above, row = row, [i + 1]
        for j, d in enumerate(text):
            row.append(min(above[j] + (c != d), above[j + 1] + 1, row[j] + 1))
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12), st.text("abc ", max_size=25))
def test_bit_parallel_distance(item, text):
    assert Pattern(item).best(text) == plain(item, text)


def test_pieces_cover_the_item():
    for n, errors in ((40, 4), (83, 8), (10, 9)):
        item = "".join(random.Random(n).choice("abc") for _ in range(n))
        assert "".join(p for _, p in cut(item, errors)) == item and len(cut(item, errors)) == errors + 1


def test_every_match_within_the_budget_is_found():
    draw = random.Random(3)
    words = ["the", "of", "erin", "thon", "and", "ble", "reha"]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(12, 30)))) for i in range(12)]
    finder, hits = Finder(items, 0.1), 0
    for _ in range(120):
        edited = list(draw.choice(items)[1])
        for _ in range(draw.randint(0, 14)):
            at, what = draw.randrange(len(edited)), draw.random()
            if what < 0.4:
                edited[at] = draw.choice("abcde ")
            elif what < 0.7:
                del edited[at]
            else:
                edited.insert(at, draw.choice("xyz"))
        noise = " ".join(draw.choice(words) for _ in range(20))
        text = f"{noise} {''.join(edited)} {noise}"
        want = {i: plain(t, text)[0] for i, t in items if plain(t, text)[0] <= budget(len(t), 0.1)}
        assert {i: d for i, d, _ in finder.find(text)} == want
        hits += len(want)
    assert hits > 50


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_edge_cases(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    item = "A passage of the benchmark, long enough to count as evidence."
    other = "Quite another question that nobody ever copied into a text!"
    items = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, None, 0), (4, "", 0), (5, "short", 0)], "item_id long, text string, doc_id int")
    rows = [
        (1, f"before {item.upper()} after"),
        (2, item.replace("benchmark", "bench mark").replace(" ", " \n ")),
        (3, "short " * 50),
        (4, None),
        (5, ""),
        (None, item),
        (6, "filler " * 40_000 + other),
        (7, item),
        (7, item),
        (8, item[:30]),
    ]
    got = decontaminate.contaminated(documents(rows), items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in got) == [(0, 1, 0), (1, 1, 0), (2, 1, 1), (6, 2, 0), (7, 1, 0), (7, 1, 0)]
    assert decontaminate.contaminated(documents([]), items).count() == 0
    assert decontaminate.contaminated(documents(rows), items.limit(0)).count() == 0


def test_short_items_are_found_as_they_are(spark, documents, tmp_path):
    item = "What is the boiling point of lead, 39?"
    spark.createDataFrame([(1, item), (2, "sum 2+2"), (3, " "), (4, "2+2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"before {item.upper()} after"), (2, item.replace("lead", "leed")), (3, "sum  2+2"), (4, "sum 2+23, consum 2+2"), (5, "so (2+2)")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_decontamination"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.budget) for r in got) == [(1, 1, 0, 0), (3, 2, 0, 0), (3, 4, 0, 0), (4, 4, 0, 0), (5, 4, 0, 0)]


def test_query_holds_every_exact_copy_and_nothing_else(spark, data, corpus):
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op4_decontamination"](spark, data).collect()}
    texts = {i: normal(t) for i, t in corpus.items()}
    exact = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t}
    assert exact <= set(got)
    for (d, i), r in got.items():
        assert (r.distance, r.end_char) == plain(items[i], texts[d]) and r.distance <= r.budget
    # documents without a hit are clean, by the plain distance
    clean = [d for d in sorted(texts, key=lambda d: len(texts[d])) if not any(k[0] == d for k in got)][:8]
    assert all(plain(item, texts[d])[0] > budget(len(item), 0.1) for d in clean for item in list(items.values())[:10])
