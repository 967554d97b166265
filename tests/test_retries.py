"""Retry stream: timers, late deliveries, waiting state, replaced rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from creaseline.operators import retry
from creaseline.operators.store import first_arrivals, stored_rows
from creaseline.operators.view import live_view
from creaseline.plans.streams import attempt_rows, injected, log_slices
from creaseline.streaming.retries import PAUSES, RETRY_ORDER, Attempts, RetryStream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def slices(spark, data):
    return log_slices(spark, data)


@pytest.fixture(scope="module")
def wanted(spark, data):
    """Store and view by the batch form over all attempts."""
    first = first_arrivals(retry.settled(attempt_rows(spark, data)), order=RETRY_ORDER)
    store = stored_rows(first, "partition", "offset", "effective_arrival")
    return rows(store), rows(live_view(first, RETRY_ORDER))


@pytest.mark.parametrize("order", [(2, 0, 1)])
def test_any_order_of_deliveries(spark, slices, wanted, order):
    stream = RetryStream(spark, *injected()).consume([slices[i] for i in order])
    assert rows(stream.store()) == wanted[0]
    assert rows(stream.view()) == wanted[1]
    assert stream.waiting().count() == 0


def test_opened_again_and_delivered_twice(spark, slices, wanted):
    """What waits survives the driver: it is in the state, not in the object."""
    first = RetryStream(spark, *injected())
    first.consume([slices[1]])
    second = RetryStream(spark, *injected(), root=first.root).consume([slices[0], slices[1], slices[2]])
    assert rows(second.store()) == wanted[0] and rows(second.view()) == wanted[1]


def test_attempts_wait_for_the_clock(spark, slices):
    """The newest record fails: its retries wait until a tick lets their time pass, one by one."""
    from creaseline.streaming.ledger import deliver

    failures, error = F.when(F.col("partition") >= 0, 2), injected()[1]
    newest = slices[0].where("value <> '{not-valid-json}'").orderBy(F.desc("timestamp")).limit(1)
    at = newest.first().timestamp
    stream = RetryStream(spark, failures, error)
    deliver(newest, f"{stream.root}/in")

    def after(seconds):
        stream.tick(F.lit(at + dt.timedelta(seconds=seconds)))
        stream.run(f"{stream.root}/in")
        return [(r.attempt, r.due_us) for r in stream.waiting().collect()]

    stream.run(f"{stream.root}/in")
    due = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 10**6)
    assert [(r.attempt, round(r.due_us / 10**6) - round(due / 10**6)) for r in stream.waiting().collect()] == [(2, 1)]
    assert [a for a, _ in after(3)] == [3] and stream.store().count() == 0
    assert after(7) == []
    (stored,) = stream.store().collect()
    assert stored.effective_arrival == at + dt.timedelta(seconds=6)


def test_a_batch_is_evaluated_once(spark):
    """The count of a batch comes from what it wrote; to count the batch itself would run its attempts again."""
    stream = RetryStream(spark, *injected())
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for frame in frames:
            seen.add(frame.num_rows)
            yield frame

    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.outcomes.schema if f.name not in ("batch_id", "status")]
    made = spark.range(5).select(F.lit("poison").alias("status"), *columns).select(*stream.outcomes.columns)
    stream.finished(made.mapInArrow(lambda batches: passed(batches), made.schema), 0)
    assert seen.value == 5 and [r.input_rows for r in stream.progress.read().collect()] == [5]


class Timers:
    def __init__(self):
        self.state, self.timers, self.clock = {}, set(), 0

    def getMapState(self, *_):
        return self

    def getCurrentWatermarkInMs(self):
        return self.clock

    def registerTimer(self, at):
        self.timers.add(at)

    def containsKey(self, key):
        return key in self.state

    def getValue(self, key):
        return self.state[key]

    def updateValue(self, key, value):
        self.state[key] = value

    def removeKey(self, key):
        del self.state[key]

    getExpiryTimeInMs = None


def test_every_failure_count_on_its_own_clock():
    """Attempts at 0, 1, 6 and 21 s; three that fall due in one millisecond share a timer."""
    from types import SimpleNamespace as N

    for late in (False, True):
        held = Timers()
        held.clock = 10**9 if late else 0
        run = Attempts(PAUSES)
        run.init(held)
        given = [N(payload=str(n), failures=n, arrival_us=500) for n in (1, 2, 3, 4, 9)] + [N(payload="x", failures=1, arrival_us=None)]
        out = list(run.handleInputRows(("m", 0), iter(given), held))
        while held.timers:
            held.clock = min(held.timers)
            held.timers.remove(held.clock)
            out += run.handleExpiredTimer(("m", 0), held, N(getExpiryTimeInMs=lambda: held.clock))
        second = 10**6
        want = {"1": ("ok", second + 500), "2": ("ok", 6 * second + 500), "3": ("ok", 21 * second + 500), "4": ("dlt", 21 * second + 500), "9": ("dlt", 21 * second + 500), "x": ("ok", None)}
        assert {r.payload: (r.status, r.due_us) for r in out} == want and len(out) == 6
        assert not held.state
