"""Decoding, headers, validation, first write wins, live view."""

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from creaseline.functions.scalars import event_sequence, header
from creaseline.operators import ingest
from creaseline.operators.store import accept, first_arrivals, storable
from creaseline.operators.view import live_view, reconcile, upsert_view
from creaseline.schemas import LOG_SCHEMA
from creaseline.sources import log as logs
from creaseline.streaming.ingest import notifications

TS = dt.datetime(2025, 4, 15, 14, 32, 1)
GOOD = {
    "eventId": "e1",
    "matchId": "m1",
    "inning": 1,
    "over": 4,
    "ball": 3,
    "team": "MI",
    "runs": 4,
    "wicket": False,
    "totalRuns": 87,
    "wickets": 2,
    "timestamp": "2025-04-15T14:32:01Z",
}
BALL = "event_id string, match_id string, inning int, over_no int, ball int, team string, runs int, extras int, wicket boolean, total_runs int, wickets int, ts timestamp_ntz"


def records(spark, values, headers=None):
    rows = [("t", 0, i, TS, "m1", v, headers) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_decode_splits_poison(spark):
    values = [json.dumps(GOOD), "{not-valid-json}", "", None, json.dumps({**GOOD, "runs": "four"}), "[1]"]
    ok, poison = logs.decode(records(spark, values))
    assert sorted(r.offset for r in ok.collect()) == [0, 3]
    assert sorted(r.offset for r in poison.collect()) == [1, 2, 4, 5]
    row = ok.where(storable()).collect()[0]
    assert row.ts == TS and row.total_runs == 87 and row.extras is None


@pytest.mark.parametrize(
    ("text", "micros"),
    [
        ("2025-04-15T14:32:01Z", 0),
        ("2025-04-15T14:32:01.5Z", 500000),
        ("2025-04-15T14:32:01.123Z", 123000),
        ("2025-04-15T14:32:01.123456Z", 123456),
        ("2025-04-15T14:32:01.123456789Z", 123456),
        ("2025-04-15T14:32:01", None),
        ("2025-04-15T14:32Z", None),
        ("2025-13-15T14:32:01Z", None),
        ("2025-04-15T14:32:01.1234567890Z", None),
        ("yesterday", None),
        ("", None),
    ],
)
def test_instants_of_any_precision(spark, text, micros):
    ok, poison = logs.decode(records(spark, [json.dumps({**GOOD, "timestamp": text})]))
    if micros is None:
        assert (ok.count(), poison.count()) == (0, 1)
    else:
        assert ok.collect()[0].ts == TS.replace(microsecond=micros) and poison.count() == 0


@pytest.mark.parametrize(("micros", "text"), [(0, "01Z"), (500000, "01.500Z"), (123000, "01.123Z"), (123456, "01.123456Z"), (7, "01.000007Z")])
def test_instants_are_written_with_the_fewest_digits(spark, micros, text):
    ball = [("e1", "m1", 1, 4, 3, "MI", 4, None, False, 87, 2, TS.replace(microsecond=micros))]
    out = logs.to_log(spark.createDataFrame(ball, BALL), F.lit(None).cast("string")).collect()[0]
    assert json.loads(out.value)["timestamp"] == f"2025-04-15T14:32:{text}"


def test_incomplete_events_cannot_be_stored(spark):
    values = [json.dumps(GOOD), "{}", json.dumps({**GOOD, "team": None}), json.dumps({**GOOD, "matchId": ""}), None]
    ok, poison = logs.decode(records(spark, values))
    assert poison.count() == 0
    assert [r.offset for r in ok.where(storable()).collect()] == [0]


def test_unknown_fields(spark):
    df = records(spark, [json.dumps({**GOOD, "venue": "x"})])
    assert logs.decode(df)[0].count() == 0
    assert logs.decode(df, unknown_fields="ignore")[0].count() == 1
    with pytest.raises(ValueError):
        logs.decode(df, unknown_fields="drop")


def test_round_trip(spark):
    ball = [("e1", "m1", 1, 4, 3, "MI", 4, None, False, 87, 2, TS)]
    out = logs.to_log(spark.createDataFrame(ball, BALL), F.lit(None).cast("string")).collect()[0]
    assert json.loads(out.value) == GOOD
    assert out.key == "m1" and out.topic == "ball-events"
    assert [(h.key, bytes(h.value)) for h in out.headers] == [
        ("X-Trace-Id", b""),
        ("X-Match-Id", b"m1"),
        ("X-Event-Id", b"e1"),
    ]


def test_headers(spark):
    headers = [("a", b"1"), ("a", b"2"), ("b", b"")]
    df = records(spark, ["x"], headers).unionByName(records(spark, ["y"]))
    got = df.select(header("a").alias("a"), header("b").alias("b"), header("c").alias("c")).collect()
    assert tuple(got[0]) == ("2", "", None)
    assert tuple(got[1]) == (None, None, None)


def test_dead_letter_without_error_headers(spark):
    rows = [("t", 17, 42, TS, "m1", "payload", None)]
    alert = notifications(logs.dead_letter_rows(spark.createDataFrame(rows, LOG_SCHEMA))).collect()[0]
    assert tuple(alert) == ("m1", 17, 42, "payload", None, None)


def request(**changes):
    base = dict(match_id="m1", inning=1, over_no=4, ball=3, team="MI", runs=4, extras=None, wicket=False, total_runs=87, wickets=2)
    base.update(changes)
    return ("e1", *[base[c] for c in ("match_id", "inning", "over_no", "ball", "team", "runs", "extras", "wicket", "total_runs", "wickets")], TS)


@pytest.mark.parametrize(
    ("changes", "fields"),
    [
        ({}, []),
        ({"match_id": None}, ["matchId"]),
        ({"match_id": " \t"}, ["matchId"]),
        ({"inning": 3}, ["inning"]),
        ({"over_no": 20}, ["over"]),
        ({"runs": 7}, ["runs"]),
        ({"extras": -1}, ["extras"]),
        ({"inning": 3, "over_no": 25, "ball": 0}, ["inning", "over", "ball"]),
        (
            dict.fromkeys(["match_id", "inning", "over_no", "ball", "team", "runs", "wicket", "total_runs", "wickets"]),
            ["matchId", "team", "inning", "over", "ball", "runs", "totalRuns", "wickets", "wicket"],
        ),
    ],
)
def test_validation(spark, changes, fields):
    row = ingest.with_errors(spark.createDataFrame([request(**changes)], BALL)).collect()[0]
    assert [e.field for e in row.errors] == fields
    answer = ingest.responses(ingest.with_errors(spark.createDataFrame([request(**changes)], BALL))).collect()[0]
    assert answer.status == (400 if fields else 202)


def test_defaults_only_fill_nulls(spark):
    rows = [("e1", TS), (None, None)]
    got = ingest.with_defaults(spark.createDataFrame(rows, "event_id string, ts timestamp_ntz")).collect()
    assert tuple(got[0]) == ("e1", TS)
    assert len(got[1].event_id) == 36 and got[1].ts is not None


DELIVERIES = [
    # event, inning, over, ball, runs, total, offset
    ("a", 1, 0, 1, 4, 4, 0),
    ("b", 1, 0, 2, 1, 5, 1),
    ("a", 1, 0, 1, 4, 4, 2),  # redelivery
    ("b-c", 1, 0, 2, 2, 6, 3),  # correction of the same ball
    ("c", 1, 0, 4, 6, 12, 4),
    ("d", 1, 0, 3, 0, 6, 5),  # late ball
]


def deliveries(spark, rows=DELIVERIES):
    full = [(e, "m1", i, o, b, "A", r, None, False, t, 0, TS, 0, off) for e, i, o, b, r, t, off in rows]
    df = spark.createDataFrame(full, BALL + ", partition int, offset long")
    return df.withColumn("event_sequence", event_sequence())


def test_accept(spark):
    accepted, duplicates = accept(deliveries(spark))
    assert {r.event_id for r in accepted.collect()} == {"a", "b", "c", "d"}
    assert sorted(r.offset for r in duplicates.collect()) == [2, 3]
    again, all_duplicates = accept(deliveries(spark), accepted)
    assert again.count() == 0 and all_duplicates.count() == len(DELIVERIES)


def test_key_variants(spark):
    assert first_arrivals(deliveries(spark), ["event_id"]).count() == 5


def test_late_ball_moves_the_view_back(spark):
    accepted, _ = accept(deliveries(spark))
    row = live_view(accepted).collect()[0]
    assert (row.total_runs, row.current_ball) == (6, 3)
    check = reconcile(live_view(accepted), accepted).collect()[0]
    assert check.event_total == 11 and check.status == "total_mismatch"


def test_result_does_not_depend_on_row_order(spark):
    results = set()
    for order in itertools.islice(itertools.permutations(DELIVERIES), 0, 720, 180):
        accepted, _ = accept(deliveries(spark, list(order)).repartition(3))
        results.add((tuple(sorted(r.event_id for r in accepted.collect())), tuple(live_view(accepted).collect())))
    assert len(results) == 1


def test_upsert_is_unconditional(spark):
    accepted, _ = accept(deliveries(spark))
    old = live_view(accepted.where("offset <= 4"))
    new = live_view(accepted.where("offset > 4"))
    row = upsert_view(old, new).collect()
    assert len(row) == 1 and row[0].total_runs == 6


def test_counters_add_up(spark):
    df = deliveries(spark).withColumn("bad", F.col("offset") == 1).withColumn("dead", F.col("offset") == 5)
    c = ingest.counters(df, F.col("bad"), F.col("dead"), ["match_id", "event_sequence"]).collect()[0]
    assert c.received == c.poison + c.processed + c.duplicate + c.dlt == 6
    assert (c.poison, c.dlt, c.duplicate) == (1, 1, 1)
