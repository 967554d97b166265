import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creaseline.llm import substring_dedup
from creaseline.llm.queries import QUERIES


def plain(rows, words=35):
    """Words, removed places and rest of every row."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for (doc_id, _), own in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(own) - words + 1):
            if seen[tuple(own[i : i + words])] > 1:
                gone.update(range(i, i + words))
        out.append((doc_id, len(own), sorted(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


def check(rows, docs, keep, words=35, **more):
    found = substring_dedup.remove_passages(docs, keep, words, **more).collect()
    for r in found:
        assert all(s.stop - s.first >= words for s in r.spans)
        assert all(a.stop < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))
    got = [(r.doc_id, r.n_words, [i for s in r.spans for i in range(s.first, s.stop)], r.rest) for r in found]
    assert sorted(got, key=repr) == sorted(plain(rows, words), key=repr)


def test_query_against_brute_force(spark, data, corpus):
    found = {r.doc_id: r for r in QUERIES["op13_substring_dedup"](spark, data).collect()}
    want = plain(sorted(corpus.items()))
    assert len(found) == len(want)
    for doc_id, n, gone, rest in want:
        r = found[doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, len(gone), hashlib.sha256(rest.encode()).hexdigest())
    assert sum(r.n_removed > 0 for r in found.values()) > 3


@pytest.mark.parametrize("vocabulary, words, seed", [(3, 5, 1), (3, 5, 5), (2, 9, 4), (40, 8, 3), (1, 6, 2)])
def test_small_vocabularies(documents, keep, vocabulary, words, seed):
    rng = random.Random(vocabulary * words)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP"[:vocabulary]) for _ in range(rng.randint(0, 60)))) for i in range(25)]
    check(rows, documents(rows), keep, words, seed=seed)


def test_shared_passages_at_any_place(documents, keep):
    rng = random.Random(5)
    fresh = iter(range(10**6))
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        part = passage[rng.randint(0, 20) : 60 - rng.randint(0, 20)]
        own = [f"w{next(fresh)}" for _ in range(rng.randint(0, 40))], [f"w{next(fresh)}" for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(own[0] + part + own[1])))
    check(rows, documents(rows), keep)


def test_awkward_rows(documents, keep):
    long = " ".join(f"x{i}" for i in range(50))
    blanks = long.replace(" ", " \t\n\x0b\x0c\r")
    rows = [(None, long), (None, long), (1, None), (1, ""), (2, blanks), (2, "é 日本 " * 40), (3, long[:-1]), (3, "only a few"), (4, "\x1c".join("ab") + " " + long), (None, None)]
    check(rows, documents(rows), keep)
    alone = [(1, long), (2, "other " + " ".join(f"y{i}" for i in range(50)))]
    check(alone, documents(alone), keep)


def test_empty_table_and_clashing_columns(documents, keep):
    assert substring_dedup.remove_passages(documents([]), keep).collect() == []
    rows = [(i, " ".join(f"x{k}" for k in range(40 + i))) for i in range(3)]
    names = ["a", "b", "first", "n", "anchor", "packed", "size", "found", "open"]
    check(rows, documents(rows).select("*", *[F.lit("clash").alias(n) for n in names]), keep)


def test_very_long_text(documents, keep):
    """Longer than a piece, one word longer than a piece, and a word repeated a hundred thousand times."""
    rng = random.Random(1)
    body = [str(rng.random()) for _ in range(60_000)]
    giant = "g" * (substring_dedup.PIECE + 7)
    rows = [(1, " ".join(body)), (2, " ".join(["other", *body[30_000:30_100], giant, "end"])), (3, "same " * 100_000), (4, " ".join([*body[:40], giant, *body[40:60]]))]
    found = {r.doc_id: r for r in substring_dedup.remove_passages(documents(rows), keep).collect()}
    assert [tuple(s) for s in found[1].spans] == [(0, 40), (30_000, 30_100)]
    assert [tuple(s) for s in found[2].spans] == [(1, 101)]
    assert [tuple(s) for s in found[3].spans] == [(0, 100_000)] and found[3].rest == ""
    assert [tuple(s) for s in found[4].spans] == [(0, 40)]


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(1, 30))) for _ in range(40_000)]
    hashes, starts = substring_dedup.word_hashes(b" ".join(words))
    by_word = {}
    for word, value in zip(words, hashes.tolist(), strict=True):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word) and np.all(np.diff(starts) > 0)


def test_parameters(documents, keep):
    with pytest.raises(ValueError):
        substring_dedup.remove_passages(documents([]), keep, words=5, seed=6)
