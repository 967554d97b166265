import pytest

from creaseline.llm import token_counts
from creaseline.llm.queries import QUERIES, tokenizer
from creaseline.session import shared_folder

BYTES = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def count():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


def test_query_against_the_library(spark, data, corpus, count):
    rows = QUERIES["op2_token_counts"](spark, data).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        n = count(corpus[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(corpus[r.doc_id].encode()), n, n > 512)


def test_cache_is_used_and_grows(spark, documents, count):
    cache = shared_folder(spark)
    first = [(1, "one text"), (2, "one text"), (3, None), (3, ""), (None, "special <|endoftext|> inside"), (4, "é" * 70_000)]
    got = token_counts.token_counts(documents(first), BYTES, cache).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted((i or 0, len((t or "").encode()), count(t)) for i, t in first)
    assert spark.read.parquet(cache).count() == 4
    # a count that is stored is not computed anew, also where the store holds it twice
    digest = token_counts.tokenizer_digest(BYTES)
    for _ in range(2):
        spark.sql(f"select unhex(sha2('known', 256)) content_digest, '{digest}' tokenizer_digest, 7777L n_tokens").write.mode("append").parquet(cache)
    second = [(1, "known"), (2, "new"), (3, "one text")]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(second), BYTES, cache).collect()}
    assert got == {1: 7777, 2: count("new"), 3: count("one text")}
    assert spark.read.parquet(cache).count() == 7
    # another tokenizer has counts of its own
    pieces = tokenizer("piece_bpe_32k.model")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(second), pieces, cache).collect()}
    assert got == {i: len(library.encode(t)) for i, t in second}


def test_empty_table(spark, documents):
    assert token_counts.token_counts(documents([]), BYTES, shared_folder(spark)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_by_pieces_equal_the_library(name, corpus):
    import random

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(name))
    counts = token_counts.PieceCounts(library, limit=500)
    assert (counts.whole is not None) == (name == "byte_bpe_50k.json")
    draw = random.Random(3)
    letters = "aB1 '\n\té—“€s t're\u0085\x1c 日́𝒳_<|>  \n"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a <|endoftext|>b", " 's 'll''ve", "x" * 100_000, " " * 10_000, *list(corpus.values())[:100]]
    for i in range(0, len(texts), 250):
        part = texts[i : i + 250]
        assert counts(part) == [len(x) for x in library.encode_batch_fast(part, add_special_tokens=False)]
