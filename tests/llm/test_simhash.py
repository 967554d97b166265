import random
import re

import numpy as np
import pytest
import xxhash

from creaseline.llm import simhash
from creaseline.llm.components import components
from creaseline.llm.queries import QUERIES


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=2):
    """Smallest id that each can reach."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    array = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        r = find(i)
        least[r] = min(x for x in (least.get(r), doc) if x is not None) if (doc is not None or least.get(r) is not None) else None
    return [least[find(i)] for i in range(len(ids))]


def test_query_against_brute_force(spark, data, corpus):
    rows = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, data).collect()}
    ids = sorted(corpus)
    fps = [plain_fingerprint(corpus[i]) for i in ids]
    assert sorted(rows) == ids
    assert [rows[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i].component_id for i in ids] == plain_components(ids, fps)


def test_edge_cases(documents, keep):
    rows = [(5, None), (3, ""), (9, " \n\t"), (7, "One"), (8, "one"), (2, "ONE two"), (4, "É two three"), (None, "one"), (8, "one")]
    found = simhash.near_duplicates(documents(rows), keep).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[i].fp & (1 << 64) - 1 for i in (5, 3, 9, 7, 8, 2, 4)] == [plain_fingerprint(dict(rows)[i]) for i in (5, 3, 9, 7, 8, 2, 4)]
    assert [by[i].component_id for i in (5, 3, 9)] == [3, 3, 3]
    assert by[7].component_id == by[8].component_id == by[None].component_id == 7
    assert by[4].component_id == 4


def test_empty_table(documents, keep):
    assert simhash.near_duplicates(documents([]), keep).count() == 0


def test_links_over_many_tiles(spark, keep, monkeypatch):
    """Chains and dense groups of fingerprints over tiles of seven."""
    monkeypatch.setattr(simhash, "TILE", 7)
    monkeypatch.setattr(simhash, "TILES_OF_TASK", 2)
    draw = random.Random(5)
    fps = {draw.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(9):  # a chain, two bits a step
            f ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            fps.add(f)
    fps |= {1 << i for i in range(64)} | {0}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.a: r.b for r in components(simhash.links(distinct, keep), keep).collect()}
    assert [roots.get(f, f) for f in signed] == plain_components(signed, [f & (1 << 64) - 1 for f in signed])


@pytest.mark.parametrize("held", [7, 1_000_000])
def test_components_of_a_long_chain_and_a_star(spark, keep, held):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(7, 7), (3, 4), (1000, 2000)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(30)
    got = [(r.a, r.b) for r in components(links, keep, held).collect()]
    assert sorted(got) == [(i, 0) for i in range(1, 101)] + [(i, 500) for i in range(501, 600)] + [(2000, 1000)]
    assert components(links.limit(0), keep, held).count() == 0
