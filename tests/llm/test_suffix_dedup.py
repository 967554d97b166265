import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from creaseline.llm import suffix_dedup
from creaseline.llm.queries import QUERIES
from creaseline.llm.suffix_array import common_prefixes, suffix_ranks


def plain_removal(docs, length=100):
    """``{doc_id: (kept bytes, spans)}`` from every string of every text."""
    first = {}
    for doc in sorted(docs):
        raw = docs[doc]
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], (doc, i))
    out = {}
    for doc, raw in docs.items():
        spans = []
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] != (doc, i):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        bounds = [0, *(x for s in spans for x in s), len(raw)]
        out[doc] = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)), spans
    return out


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("ab", max_size=80), st.text("abcdefgh", max_size=60), st.text("ab", max_size=12).map(lambda t: t * 7)))
def test_suffix_ranks(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    ranks = suffix_ranks(np.frombuffer(text.encode(), np.uint8))
    assert [ranks[i] for i in order] == list(range(len(text)))


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=60), st.data())
def test_wanted_suffixes_and_common_prefixes(text, data):
    wanted = np.array(sorted(data.draw(st.sets(st.sampled_from(range(len(text))), min_size=1))))
    codes = np.frombuffer(text.encode(), np.uint8)
    order = np.argsort(suffix_ranks(codes, wanted))
    assert [text[i:] for i in wanted[order]] == sorted(text[i:] for i in wanted)
    before = np.full(len(wanted), -1)
    before[order[1:]] = wanted[order[:-1]]
    for least in (1, 4, 9):
        shares = common_prefixes(codes, wanted, before, least)
        plain = [b >= 0 and len(text) - max(a, b) >= least and text[a : a + least] == text[b : b + least] for a, b in zip(wanted, before, strict=True)]
        assert shares.tolist() == plain


def test_segments_hold_every_string_once_and_follow_the_content():
    draw = random.Random(1)
    passage = bytes(draw.choice(b"abcdef ") for _ in range(500))
    hashes = []
    for front in (b"", b"xyz" * 40):
        keys, starts, counts, _ = suffix_dedup.segments(front + passage)
        assert starts.tolist() == [0, *np.cumsum(counts)[:-1].tolist()] and counts.sum() == len(front) + 401
        hashes.append(np.repeat(keys, counts)[len(front) :])
    assert (hashes[0] == hashes[1]).all()
    assert len(suffix_dedup.segments(b"a" * 99)[0]) == 0
    keys, starts, counts, periodic = suffix_dedup.segments(b"a" * 200_000)
    assert counts.sum() == 199_901 and counts.max() <= 0xFFF and len(set(keys.tolist())) == 1 and periodic.all()


@pytest.mark.parametrize("shard", [1, 1 << 20])
def test_planted_repeats(documents, shard):
    draw = random.Random(2)
    make = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passage, line = make(260), make(130)
    rows = [(i, make(draw.randint(0, 400)) + (passage[draw.randint(0, 60) :] if i % 3 == 0 else "") + make(50) + (line if i % 4 == 0 else "")) for i in range(60)]
    rows += [(100, rows[10][1]), (101, rows[10][1]), (102, "-" * 700), (103, "-" * 300), (104, "abc" * 90), (105, ""), (106, None), (107, line * 5), (108, "x" * 99)]
    want = plain_removal({i: (t or "").encode() for i, t in rows})
    got = suffix_dedup.remove_repeats(documents(rows, 5), shard=shard).collect()
    assert {r.doc_id: (bytes(r.kept), [[s.start, s.stop] for s in r.spans]) for r in got} == want


def test_repeated_rows_null_ids_and_extra_columns(documents):
    from pyspark.sql import functions as F

    text, other = "the same text " * 3 + "q" * 100, "another beginning, then " + "q" * 100
    rows = [(1, text), (1, text), (1, other), (None, text), (None, text)]
    docs = documents(rows).withColumn("packed", F.lit("x")).withColumn("tag", F.lit(1)).withColumn("place", F.lit(2))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == 5
    kept = {(r.doc_id, bytes(r.kept).decode()) for r in got}
    assert (None, "") in kept and len([r for r in got if r.doc_id is None]) == 2
    # one of the two texts under id 1 keeps the blank and the run of q, the other loses them
    assert kept - {(None, "")} in ({(1, text), (1, other[:23])}, {(1, text[:41]), (1, other)})


def test_empty_table(documents):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_query_against_brute_force(spark, data, corpus):
    want = plain_removal({i: t.encode() for i, t in corpus.items()})
    rows = QUERIES["op8_suffix_dedup"](spark, data).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        kept, spans = want[r.doc_id]
        raw = corpus[r.doc_id].encode()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("one_id", [None, 7])
def test_thousands_of_texts_under_one_id_or_none(documents, keep, one_id):
    """Far more texts than their first digest tells apart; each passage of two texts leaves one of them, whichever is first."""
    draw = random.Random(4)
    fresh = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=130)) for _ in range(12_000)]
    shared = ["".join(draw.choices("ABCDEFGH", k=150)) for _ in range(40)]
    texts = [fresh[i] + "<("[i % 2] + (shared[i // 2] if i < 80 else "") + ">)"[i % 2] + fresh[i][:20] for i in range(len(fresh))]
    out = suffix_dedup.remove_repeats(documents([(one_id, t) for t in texts] + [(3, texts[-1])]), keep=keep).collect()
    assert len(out) == len(texts) + 1
    lost = sorted((s.start, s.stop) for r in out for s in r.spans)
    whole = len(texts[-1])
    # the copy under another id is the only one that loses a whole text
    assert lost.count((0, whole)) == 1 and lost.count((131, 281)) == 40 and len(lost) == 41
    kept = {bytes(r.kept).decode() for r in out}
    assert all((t in kept) + (t[:131] + t[281:] in kept) == 1 for t in texts[:80]) and set(texts[80:]) <= kept
