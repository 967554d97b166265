import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from creaseline.llm import shards
from creaseline.llm.queries import QUERIES
from creaseline.session import shared_folder


def check(rows, count, of):
    assert sorted((i or 0, t or "") for i, t, *_ in rows) == sorted((i or 0, t or "") for i, t in of)
    slots = defaultdict(list)
    for _, text, size, shard, slot in rows:
        assert size == len((text or "").encode()) + 16
        slots[shard].append(slot)
    assert set(slots) <= set(range(count))
    sizes = [len(slots[s]) for s in range(count)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def read(written):
    return [(r.record.doc_id, r.record.text, r.size, r.shard, r.slot) for r in written.collect()]


def test_law_over_many_buckets(spark, documents):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(9000 + i, "copy") for i in range(250)] + [(7, None), (None, "n"), (7, None)]
    extra = documents(rows).withColumn("shard", F.lit("clash")).withColumn("a`b", F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2))))
    for bucket in (300, 1 << 24):
        written = shards.write_shards(extra, shared_folder(spark), shards=7, bucket_bytes=bucket)
        check(read(written), 7, rows)
        assert written.select("record.shard").distinct().collect()[0][0] == "clash"
    assert sorted(set(r.shard for r in written.collect())) == list(range(7))


def test_seed_decides_the_order(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(300)], 1)
    orders = [
        [r.record.doc_id for r in shards.write_shards(docs, shared_folder(spark), shards=1, seed=s, bucket_bytes=500).orderBy("slot").collect()]
        for s in (1, 1, 2)
    ]
    assert orders[0] == orders[1] != orders[2]
    assert orders[0] != sorted(orders[0])
    # uniform enough: the mean distance of neighbours is about a third of the table
    gaps = [abs(a - b) for a, b in zip(orders[0], orders[0][1:], strict=False)]
    assert 70 < sum(gaps) / len(gaps) < 130


def test_few_rows_and_none(spark, documents):
    check(read(shards.write_shards(documents([(1, "a"), (2, "b")]), shared_folder(spark))), 40, [(1, "a"), (2, "b")])
    assert shards.write_shards(documents([]), shared_folder(spark)).count() == 0


def test_query(spark, data, corpus):
    rows = QUERIES["op3_sharding"](spark, data).collect()
    check([(r.doc_id, corpus[r.doc_id], r.size, r.shard, r.slot) for r in rows], 40, list(corpus.items()))
    assert all(r.text_crc32 == zlib.crc32(corpus[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
