import hashlib
import re

import pytest
from pyspark.sql import functions as F

from creaseline.llm import fill_middle
from creaseline.llm.queries import QUERIES


def plain(doc_id, text):
    """``form, output, n, prefix_chars, middle_chars`` as the contract says."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", text, len(units), None, None
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return form, out, len(units), len(pre), len(mid)


def arranged(docs):
    out = fill_middle.fill_in_middle(docs)
    return out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()


def check(rows, found):
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.form, r.output, r.n, r.prefix_chars, r.middle_chars, r.back) for r in found), key=repr)
    assert got == want


def test_query_against_brute_force(spark, data, corpus):
    rows = QUERIES["op12_fill_middle"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(corpus)
    for r in rows:
        form, out, n, prefix, middle = plain(r.doc_id, corpus[r.doc_id])
        assert (r.form, r.n, r.prefix_chars, r.middle_chars) == (form, n, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(corpus[r.doc_id].encode()).hexdigest()
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_awkward_texts(documents):
    texts = [None, "", "a", " ", "\n", "\r\n\x85  x", "é", "日本語 and 𝒳𝒴 end", "$1 \\Q \\E $2", "<P", "P><S", "x<M>y", "a\x00b", "<<<", "<S<", "aB9zz'q-"]
    rows = [(i * 100 + k, t) for i, t in enumerate(texts) for k in range(12)]
    check(rows, arranged(documents(rows)))


def test_null_and_repeated_ids(documents):
    rows = [(None, "one two"), (None, "one two"), (None, None), (7, "same"), (7, "same"), (7, "other words")]
    check(rows, arranged(documents(rows)))


def test_very_long_texts(documents):
    rows = [(i, t) for t in ("word " * 400_000, "é" * 700_000, "x" * 2_000_000, "a\n" * 500_000) for i in (1, 2, 3, 5)]
    check(rows, arranged(documents(rows)))


def test_empty_table_and_clashing_columns(documents):
    assert fill_middle.fill_in_middle(documents([])).collect() == []
    names = ["n", "form", "output", "h1", "a", "b", "prefix_chars"]
    docs = documents([(3, "some words here")]).select("*", *[F.lit("clash").alias(n) for n in names])
    check([(3, "some words here")], arranged(docs))


def test_parameters(documents):
    docs = documents([(i, f"text number {i} of many <P>") for i in range(50)])
    markers = ("\x01pre|", "\x02suf$1", "\x03mid\\")
    made = fill_middle.fill_in_middle(docs, seed=9, arranged=100, suffix_first=100, markers=markers)
    found = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), markers)).collect()
    assert {r.form for r in found} == {"spm"}
    assert {r.back for r in found} == {f"text number {i} of many <P>" for i in range(50)}
    assert all(r.output.startswith("\x02suf$1") for r in found)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, markers=("<P>", "<P<", "<M>"))
