import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from creaseline.llm import pieces
from creaseline.llm.queries import QUERIES, tokenizer

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = library.encode(text or "")
    return list(ids), library.decode(list(ids)) if ids else ""


TABLE = pieces.ChunkTable(MODEL, limit=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ▁\n\t\r\0é中🙂<0xA> 　ﬁ."), max_size=30), max_size=4))
def test_chunk_table_equals_the_library(several):
    import numpy as np
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = [(np.frombuffer(ids, np.int32).tolist(), decoded) for ids, decoded in TABLE.encode(several)]
    assert TABLE.separable
    assert got == [expected(library, t) for t in several]


def test_whole_texts_where_pieces_may_cross(library, monkeypatch):
    import numpy as np

    monkeypatch.setattr(pieces.ChunkTable, "_separable", lambda self: False)
    texts = ["", " two  words", "a\nb"]
    got = [(np.frombuffer(i, np.int32).tolist(), d) for i, d in pieces.ChunkTable(MODEL).encode(texts)]
    assert got == [expected(library, t) for t in texts]


def test_edge_cases(documents, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "word " * 60_000), (5, "x" * 200_000)]
    got = pieces.encode_decode(documents(rows), MODEL).collect()
    key = lambda r: (r[0] or 0, r[1])
    want = [(i, *expected(library, t)) for i, t in rows]
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got], key=key) == sorted(want, key=key)
    assert pieces.encode_decode(documents([]), MODEL).count() == 0


def test_query_against_the_library(spark, data, corpus, library):
    rows = QUERIES["op1_sentencepiece"](spark, data).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        ids, decoded = expected(library, corpus[r.doc_id])
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest())
