import base64
import hashlib
import zlib

import pytest

from creaseline.llm import warc
from creaseline.session import shared_folder

PAGES = "page_id long, url string, html string"


def build(spark, rows, folder, lines=3, least=0):
    pages = spark.createDataFrame(rows, PAGES).repartition(3).selectExpr("*", "'x' as digest", "1 as file")
    captures = warc.write_archives(pages, folder, least)
    return pages, captures, warc.build_index(captures, folder, lines)


def want(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least:
            first[raw] = min(x for x in (first.get(raw, page_id), page_id) if x is not None) if page_id is not None or first.get(raw) is not None else None
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        of = first.get(raw, page_id)
        revisit = page_id != of
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://www.site{i % 3}.example.com/p?b={i}&a=1", f"<p>{i % 7}é</p>") for i in range(40)]
ROWS += [(50, None, None), (51, "", ""), (52, "not a url at all\r\nX: y", "x" * 300_000), (53, "http://[bad/", "<p>1é</p>"), (53, "http://[bad/", "<p>1é</p>")]
ROWS += [(i, "http://hot.example.org/", "same") for i in range(60, 90)]


@pytest.mark.parametrize("slice_", [2, 50_000])
@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, keep, monkeypatch, least, slice_):
    monkeypatch.setattr(warc, "DIRECTORY_SLICE", slice_)
    folder = shared_folder(spark)
    pages, captures, directory = build(spark, ROWS, folder, least=least)
    assert captures.count() == len(ROWS) and directory.count() > 10
    found = warc.lookup(pages, folder)
    got = warc.page_digests(found, keep).collect()
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=str) == want(ROWS, least)
    payloads = {r.page_id: bytes(r.payload).decode() for r in found.collect() if r.record_type == "response"}
    assert all((h or "") == payloads[i] for i, _, h in ROWS if i in payloads)


def test_archives_are_plain_warc(spark):
    folder = shared_folder(spark)
    build(spark, ROWS, folder)
    records = 0
    store, root = warc._store(f"{folder}/warc")
    import pyarrow.fs as pafs

    for info in store.get_file_info(pafs.FileSelector(root)):
        raw = store.open_input_stream(info.path, compression=None).read()
        while raw:
            member = zlib.decompressobj(31)
            block = member.decompress(raw)
            raw = member.unused_data
            head, _, rest = block.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and len(rest) == int(headers["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
            records += 1
    assert records == len(ROWS)


def test_keys_without_a_capture(spark):
    folder = shared_folder(spark)
    build(spark, ROWS, folder)
    wanted = spark.createDataFrame([(1, "http://nowhere.example/"), (3, ROWS[3][1]), (4, ROWS[3][1]), (50, None)], "page_id long, url string")
    assert sorted(r.page_id for r in warc.lookup(wanted, folder).collect()) == [3, 50]


def test_null_page_id_and_empty_table(spark, keep):
    folder = shared_folder(spark)
    rows = [(None, "http://a.example/", "q"), (4, "http://b.example/", "q"), (None, "http://c.example/", "only")]
    pages, _, _ = build(spark, rows, folder)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_digests(warc.lookup(pages, folder), keep).collect()}
    assert got == {(None, "revisit", 4, 1), (4, "response", None, 1), (None, "response", None, 4)}
    empty = shared_folder(spark)
    pages, captures, _ = build(spark, [], empty)
    assert captures.count() == warc.lookup(pages, empty).count() == 0


def test_one_page_id_with_two_payloads(spark, keep):
    rows = [(1, "http://a.example/", "AAAA"), (1, "http://a.example/", "BBBBBBBB"), (2, "http://b.example/", "BBBBBBBB"), (3, "http://c.example/", "AAAA"), (1, "http://d.example/", "AAAA")]
    folder = shared_folder(spark)
    pages, _, _ = build(spark, rows, folder)
    got = warc.page_digests(warc.lookup(pages, folder), keep).collect()
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=str) == want(rows)


def test_url_keys():
    assert warc.url_key("HTTPS://User@WWW.Example.COM:8080/A b?z=1&a=2#f") == "com,example,www)/A%20b?a=2&z=1"
    assert warc.url_key("http://example.com") == "com,example)/"
    assert warc.url_key(None) == warc.url_key("") == ""
    assert "\t" not in warc.url_key("http://e.com/\t\n") and "\n" not in warc.url_key("http://[x\t\n")
