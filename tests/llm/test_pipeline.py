"""The stages, each against a brute-force version on its own input."""

import hashlib

import pytest

import corpus_pipeline
from creaseline.llm.queries import tokenizer
from creaseline.session import materialize

from .test_decontaminate import plain
from .test_quality_rules import plain_stats
from .test_simhash import plain_components, plain_fingerprint
from .test_suffix_dedup import plain_removal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, data):
    """What each stage read, and the last result."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], data)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_pass_through(tables):
    assert all(t.columns == COLUMNS and t.schema == tables[0].schema for t in tables[:-1])


def test_quality_stage(tables):
    before, after = rows(tables[0]), rows(tables[1])
    base = {i for i, r in before.items() for s in [plain_stats(r.text)] if s[0] >= 20 and 100 * s[4] <= 30 * s[0]}
    assert set(after) <= base and len(after) >= 0.98 * len(base)
    assert all(after[i] == before[i] for i in after)


def test_near_duplicate_stage(tables):
    before, after = rows(tables[1]), rows(tables[2])
    ids = sorted(before)
    roots = plain_components(ids, [plain_fingerprint(before[i].text) for i in ids])
    assert set(after) == {i for i, r in zip(ids, roots, strict=True) if i == r}
    assert all(after[i] == before[i] for i in after)


def test_passage_stage(tables):
    before, after = rows(tables[2]), rows(tables[3])
    for i, (kept, spans) in plain_removal({i: r.text.encode() for i, r in before.items()}).items():
        text = kept.decode(errors="ignore")
        if spans and not text.strip(" "):
            assert i not in after
        else:
            assert after[i].text == text and after[i].n_chars == (len(text) if spans else before[i].n_chars)


def test_benchmark_stage(spark, data, tables):
    before, after = rows(tables[3]), rows(tables[4])
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    gone = set(before) - set(after)
    spelled = {i: " ".join(r.text.lower().split()) for i, r in before.items()}
    assert {i for i, t in spelled.items() if any(x in t for x in items)} <= gone
    assert all(min(plain(x, spelled[i])[0] / len(x) for x in items) <= 0.1 for i in list(gone)[:5])


def test_encoding_stage(tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    before, after = rows(tables[4]), rows(tables[5])
    assert set(before) == set(after)
    for i, r in after.items():
        ids = library.encode(before[i].text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_documents(spark, data, documents):
    """Nulls, empty texts, repeated rows, an empty table and clashing extra columns pass every stage."""
    sound = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    table = [(i, t) for i, t in enumerate(sound)] + [(3, sound[3]), (None, sound[5] + " more words"), (100, None), (101, ""), (102, "x" * 200_000)]
    docs = documents(table).selectExpr("*", "1 as kept", "'a' as record", "2 as `__gone`", "3 as rest", "4 as digest")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = materialize(stage(spark, docs, data)), materialize(stage(spark, empty, data))
        assert empty.count() == 0 and docs.count() > 10, name
        if name != "sentencepiece":
            assert docs.columns == [*COLUMNS, "kept", "record", "__gone", "rest", "digest"]


def test_rows_answer_for_themselves(spark, data, documents):
    """Rows without an id, or with a shared one, stay or go by their own text; one row of a group stays."""
    _, *stages = corpus_pipeline.STAGES
    first = corpus_pipeline.quality
    sound = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en' and n_chars > 600").orderBy("doc_id").limit(30).collect()]
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    alone = [(None, "too few words", "en"), (None, sound[0], "en"), (7, "too few again", "en"), (7, sound[1], "en")]
    got = first(spark, documents(alone), data).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, sound[0]), (7, sound[1])])
    rows = [(1, sound[2]), (None, sound[2]), (None, sound[3]), (None, sound[3]), (None, sound[4]), (5, sound[5]), (5, sound[5])]
    got = dict(stages)["simhash_near_dedup"](spark, documents(rows), data).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, sound[3]), (0, sound[4]), (1, sound[2]), (5, sound[5])])
    rows = [(None, f"so {item} it is"), (None, "nothing of that kind")]
    got = dict(stages)["benchmark_decontamination"](spark, documents(rows), data).collect()
    assert [r.text for r in got] == ["nothing of that kind"]


def test_run_equals_its_stages(spark, data, tables):
    last = sorted(map(tuple, tables[-1].drop("ids").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).drop("ids").collect())) == last
