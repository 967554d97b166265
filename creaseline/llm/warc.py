"""WARC archives and a two-level capture index.

Every page becomes a record, compressed by itself, in an archive file of its task. The index sorts the captures by
reversed-host URL key into compressed blocks; a sparse directory holds the first key and the place of each block.
A lookup searches the directory, reads that one block, searches it and reads the record's range.

A task that runs again writes files under new names; only the places that a finished task returned are indexed,
so a lost executor leaves unread files and no wrong entry. Files are opened through ``pyarrow.fs``, so the folder
may lie in any store it knows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from creaseline.llm.common import parts

CAPTURE = "urlkey string, page_id long, file string, offset long, length long"
ENTRY = "urlkey string, page_id long, file string, offset long, length long"
ROLL = 256 << 20  # bytes of an archive file
LINES = 1000  # captures in a block
DIRECTORY_SLICE = 50_000  # directory entries that one broadcast holds
GZIP = 31


def url_key(url: str | None) -> str:
    """``com,example,www)/path?a=1&b=2``: host reversed, scheme, port, user and fragment dropped, query sorted."""
    if not url:
        return ""
    try:
        cut = urlsplit(url.strip())
        host = (cut.hostname or "").rstrip(".")
    except ValueError:
        return quote(url, safe="/:?&=%,;@+!$'()*~#")
    query = "?" + "&".join(sorted(cut.query.split("&"))) if cut.query else ""
    return quote(",".join(reversed(host.split("."))) + ")" + (cut.path or "/") + query, safe="/:?&=%,;@+!$'()*~")


def sort_key(key: str, page_id: int | None) -> tuple:
    """Order of the index, as Spark sorts it: nulls first."""
    return key, page_id is not None, page_id or 0


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if re.match(r"\w+://|file:", folder) else (pafs.LocalFileSystem(), folder)


def _clean(value: str) -> str:
    """A header value on one line."""
    return quote(value, safe="".join(map(chr, range(33, 127))))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pack(block: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, GZIP)
    return squeeze.compress(block) + squeeze.flush()


def _record(page_id, url, payload: bytes, first_id, first_url, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first_id}>",
            f"WARC-Refers-To-Target-URI: {_clean(first_url or '')}",
        ]
    return _pack("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record."""
    head, _, block = zlib.decompress(packed, GZIP).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = block[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


class _Appender:
    """Appends to files of its own, a new one whenever ``roll`` bytes are reached."""

    def __init__(self, folder: str, ending: str, roll: int = ROLL):
        self.store, self.root = _store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.ending, self.roll = ending, roll
        self.out, self.name, self.at = None, "", 0

    def add(self, block: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.roll:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.ending}", 0
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(block)
        place = self.name, self.at, len(block)
        self.at += len(block)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class _Ranges:
    """Range reads with a few files open."""

    def __init__(self, folder: str):
        self.store, self.root = _store(folder)
        self.file = lru_cache(8)(lambda name: self.store.open_input_file(f"{self.root}/{name}"))

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``folder/warc``; return the captures, kept as ``folder/captures``.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and
    the others revisit it. A null html is an empty payload, a null url an empty key; repeated rows of a response are
    responses. The pages are dealt by digest with copies split over tasks by the adaptive join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Appender(f"{folder}/warc", ".warc.gz")
        held = []
        for batch in batches:
            rows = []
            for page_id, url, html, first_id, first_url, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = out.add(_record(page_id, url, html.encode(), first_id, first_url, revisit))
                rows.append((url_key(url), page_id, *place))
            held.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names) if rows else None)
        out.close()  # before any place in it becomes known
        yield from filter(None, held)

    names = ["urlkey", "page_id", "file", "offset", "length"]
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1("html")))
    )
    first = rows.where("digest is not null").groupBy("digest").agg(
        # nulls sort first, but a page without id is never the one to refer to while another has one
        F.min(F.struct(F.col("page_id").isNull(), F.col("page_id").alias("page_id"), F.col("url").alias("url"))).alias("first")
    )
    marked = rows.join(first, "digest", "left").select(
        "page_id",
        "url",
        "html",
        F.col("first.page_id").alias("first_id"),
        F.col("first.url").alias("first_url"),
        (F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).alias("revisit"),
    )
    marked.mapInArrow(run, CAPTURE).write.mode("overwrite").parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(CAPTURE).parquet(f"{folder}/captures")


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Write the sorted blocks to ``folder/index`` and the directory to ``folder/directory``; return the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Appender(f"{folder}/index", ".cdx.gz")
        entries, block = [], []

        def close_block() -> None:
            text = "".join(f"{k}\t{p}\t{json.dumps(rest)}\n" for k, p, *rest in block)
            entries.append((block[0][0], block[0][1], *out.add(_pack(text.encode()))))
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append((row[0], json.dumps(row[1]), *row[2:]))
                if len(block) == lines:
                    close_block()
        if block:
            close_block()
        out.close()
        if entries:
            cols = list(zip(*entries, strict=True))
            ids = pa.array([json.loads(x) for x in cols[1]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), ids, *map(pa.array, cols[2:])], names)

    names = ["urlkey", "page_id", "file", "offset", "length"]
    ordered = captures.repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")
    ordered.mapInArrow(run, ENTRY).write.mode("overwrite").parquet(f"{folder}/directory")
    return captures.sparkSession.read.schema(ENTRY).parquet(f"{folder}/directory")


def _directory(spark: SparkSession, folder: str) -> Iterator[list]:
    """The directory in order, in slices of bounded size; each slice ends with the first entry of the next."""
    entries = spark.read.schema(ENTRY).parquet(f"{folder}/directory").orderBy("urlkey", "page_id", "file", "offset")
    held: list = []
    for row in entries.toLocalIterator():
        held.append(tuple(row))
        if len(held) > DIRECTORY_SLICE:
            yield held
            held = held[-1:]
    if held:
        yield held


def lookup(wanted: DataFrame, folder: str) -> DataFrame:
    """All records of the captures ``(url, page_id)`` in ``wanted``: headers of interest and payload.

    Returns ``page_id, url, record_type, refers_to, payload binary, payload_digest``; the payload is
    null for a revisit, the digest is the record's own. Keys without a capture give no row, an empty index gives none at all.
    """
    spark = wanted.sparkSession
    found: DataFrame | None = None
    for slice_ in _directory(spark, folder):
        part = _lookup_slice(wanted, folder, slice_)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], FOUND) if found is None else found


FOUND = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string"


def _lookup_slice(wanted: DataFrame, folder: str, slice_: list) -> DataFrame:
    more = len(slice_) > DIRECTORY_SLICE  # then the last entry belongs to the next slice
    entries = wanted.sparkSession.sparkContext.broadcast((slice_, more))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, more = entries.value
        firsts = [sort_key(e[0], e[1]) for e in directory]
        own = len(directory) - more
        for batch in batches:
            rows = []
            for url, page_id in zip(batch["url"].to_pylist(), batch["page_id"].to_pylist(), strict=True):
                key = url_key(url)
                at = sort_key(key, page_id)
                # equal keys may fill several blocks, and the first of them may lie at the end of the block before
                for i in range(max(0, bisect_left(firsts, at) - 1), min(own, bisect_right(firsts, at))):
                    rows.append((*directory[i][2:], key, page_id))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, cols[:4]), pa.array(cols[4], pa.int64())], ["file", "offset", "length", "key", "page_id"]
                )

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, keys, lines = _Ranges(f"{folder}/index"), None, [], []
        for batch in batches:
            rows = []
            for name, offset, length, key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known != (name, offset):
                    text = zlib.decompress(index.read(name, offset, length), GZIP).decode()
                    lines = [line.split("\t") for line in text.split("\n")[:-1]]
                    keys = [sort_key(k, json.loads(p)) for k, p, _ in lines]
                    known = name, offset
                at = sort_key(key, page_id)
                rows += [json.loads(lines[i][2]) for i in range(bisect_left(keys, at), bisect_right(keys, at))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Ranges(f"{folder}/warc")
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

        def number(header: str | None) -> int | None:
            return json.loads(header[len("<urn:page:") : -1].replace("None", "null")) if header else None

        for batch in batches:
            rows = []
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers, payload = parse_record(archive.read(name, offset, length))
                kind = headers["WARC-Type"]
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"damaged record at {offset} of {name}")
                own = (payload if kind == "response" else None, digest)
                rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, number(headers.get("WARC-Refers-To")), *own))
                if sum(len(r[4] or b"") for r in rows[-256:]) > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    placed = wanted.select("url", "page_id").distinct().mapInArrow(blocks, "file string, offset long, length long, key string, page_id long")
    # as many tasks as the session has for a shuffle: what a task does follows its records, not the bytes of the keys
    read = placed.repartition(parts(wanted.sparkSession), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(captures, "file string, offset long, length long")
    return read.mapInArrow(records, FOUND)


def page_digests(found: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per record; a revisit shows the payload of the response that it refers to.

    That is a record of the page with the revisit's own payload digest: pages that share an id may differ in payload.
    ``keep`` writes the records' rows, without payloads, so that they are read once.
    """
    size = F.octet_length("payload").cast("long").alias("payload_bytes")
    rows = keep(found.select("page_id", "record_type", "refers_to", size, "payload_digest"))
    responses = rows.where("record_type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("with")).agg(F.min("payload_bytes").alias("payload_bytes"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes")
    same = revisits["refers_to"].eqNullSafe(sizes["of"]) & (revisits["payload_digest"] == sizes["with"])
    return responses.unionByName(revisits.join(sizes, same, "left").drop("of", "with")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
