"""Streams: redelivery, repeated batches, conservation, change feed."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from creaseline.plans import inputs
from creaseline.plans.streams import CUTS, injected, log_slices
from creaseline.session import shared_folder
from creaseline.sources.log import dead_letter_rows, from_broker
from creaseline.streaming.ingest import ScoreStream
from creaseline.streaming.ledger import Stream, arrivals, deliver
from creaseline.streaming.retries import RetryStream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repeated_batch_changes_nothing(spark, data):
    """A batch that runs a second time, as after a failure before its commit, overwrites itself."""
    slices = log_slices(spark, data)
    stream = ScoreStream(spark).consume(slices)
    store, view = rows(stream.store()), rows(stream.view())
    stream.process(slices[2], 2)
    assert rows(stream.store()) == store and rows(stream.view()) == view


def test_half_written_batch_is_completed(spark, data):
    """Store written, view not: the repeated batch brings the view up to date."""
    slices = log_slices(spark, data)
    clean = ScoreStream(spark).consume(slices)
    broken = ScoreStream(spark).consume(slices[:2])
    view_write, broken.views.write = broken.views.write, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    try:
        broken.process(slices[2], 2)
    except OSError:
        pass
    broken.views.write = view_write
    broken.process(slices[2], 2)
    assert rows(broken.view()) == rows(clean.view())
    assert rows(broken.store()) == rows(clean.store())


def test_compaction_keeps_store_and_view(spark, data):
    slices = log_slices(spark, data)
    stream = ScoreStream(spark).consume(slices[:2])
    store, view = rows(stream.store()), rows(stream.view())
    stream.compact()
    assert rows(stream.store()) == store and rows(stream.view()) == view
    assert stream.events.folded[0] == 0
    # duplicates of compacted balls are still recognised, and the rest still arrives
    stream.consume([slices[0], slices[2]])
    clean = ScoreStream(spark).consume(slices)
    assert rows(stream.store()) == rows(clean.store()) and rows(stream.view()) == rows(clean.view())
    stream.compact()
    assert stream.events.folded[0] == 2
    assert rows(stream.store()) == rows(clean.store()) and rows(stream.view()) == rows(clean.view())


@pytest.mark.parametrize("sink", ["views", "counts"])
def test_reopened_by_path_after_a_failure_and_a_compaction(spark, data, sink):
    """A driver stops inside a batch, another compacts, a third goes on: all that survives is the root folder."""
    slices = log_slices(spark, data)
    clean = ScoreStream(spark).consume(slices)
    first = ScoreStream(spark).consume(slices[:2])
    deliver(slices[2], f"{first.root}/in")
    getattr(first, sink).write = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(StreamingQueryException):
        first.run(f"{first.root}/in")
    ScoreStream(spark, first.root).compact()
    third = ScoreStream(spark, first.root)
    assert third.events.folded is not None
    third.run(f"{third.root}/in")
    assert rows(third.view()) == rows(clean.view()) and rows(third.store()) == rows(clean.store())
    assert rows(third.counts.read()) == rows(clean.counts.read())
    assert rows(third.progress.read()) == rows(clean.progress.read())


def test_progress_of_many_batches(spark):
    """More batches than a query keeps reports of."""

    class Quiet(Stream):
        def process(self, batch, batch_id):
            pass

    stream = Quiet(spark)
    spark.range(110).coalesce(1).write.option("maxRecordsPerFile", 1).parquet(f"{stream.root}/in")
    stream.run_available(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{stream.root}/in"))
    seen = {r.batch_id: r.input_rows for r in stream.progress.read().collect()}
    assert len(seen) == 110 and set(seen.values()) == {1}
    assert stream.safe() == 108


def test_retries_keep_unreadable_records(spark, data):
    log = inputs.log(spark, data)
    stream = RetryStream(spark, *injected()).consume([log])
    assert stream.poison.read().count() == log.where("value = '{not-valid-json}'").count() > 0


def test_broker_columns(spark, data):
    """A stream with a broker's column types, from files: binary key and value, a time with a zone."""
    slices = log_slices(spark, data)
    kinds = {"key": "binary", "value": "binary", "timestamp": "timestamp"}
    raw = slices[0].select(*[F.col(c).cast(kinds.get(c, slices[0].schema[c].dataType)).alias(c) for c in slices[0].columns])
    path = f"{shared_folder(spark)}/in"
    deliver(raw, path)
    stream = ScoreStream(spark)
    stream.run(from_broker(spark.readStream.schema(raw.schema).parquet(path)))
    clean = ScoreStream(spark).consume(slices[:1])
    assert rows(stream.store()) == rows(clean.store()) and rows(stream.poison.read()) == rows(clean.poison.read())


def test_conservation(spark, data):
    stream = ScoreStream(spark).consume(log_slices(spark, data))
    received, poison, accepted = stream.counts.read().agg(F.sum("received"), F.sum("poison"), F.sum("accepted")).first()
    log = inputs.log(spark, data)
    assert received == log.count() and poison == log.where("value = '{not-valid-json}'").count()
    assert accepted == stream.store().count() == inputs.accepted(spark, data).count()


def test_incomplete_events_become_dead_letters(spark, data):
    log = inputs.log(spark, data)
    broken = F.when((F.col("partition") == 3) & (F.col("offset") == 0), "{}").otherwise(F.col("value"))
    stream = ScoreStream(spark).consume([log.withColumn("value", broken)])
    dead = dead_letter_rows(stream.dead.read()).collect()
    assert [(d.partition, d.offset, d.original_offset) for d in dead] == [(3, 0, "0")]
    totals = stream.counts.read().agg(F.sum("received"), F.sum("dlt")).first()
    assert tuple(totals) == (log.count(), 1)


def test_one_delivery_or_three(spark, data):
    log = inputs.log(spark, data)
    once = ScoreStream(spark).consume([log])
    thrice = ScoreStream(spark).consume(arrivals(log, "timestamp", CUTS))
    assert rows(once.view()) == rows(thrice.view())


def test_retry_waits_across_batches(spark, data):
    """A cut right after a failing ball leaves its retries for the next batch."""
    log = inputs.log(spark, data)
    failing = log.where(F.col("key") != "").orderBy("timestamp").select("timestamp").collect()
    cut = failing[len(failing) // 2][0] + dt.timedelta(microseconds=1)
    whole = RetryStream(spark, *injected()).consume([log])
    split = RetryStream(spark, *injected()).consume(arrivals(log, "timestamp", [str(cut)]))
    columns = [c for c in whole.events.columns]
    assert rows(whole.events.read().select(*columns)) == rows(split.events.read().select(*columns))
    assert rows(whole.view()) == rows(split.view())
