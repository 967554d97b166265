"""Record layouts: wire record, log record, stored event, live view."""

from __future__ import annotations

from pyspark.sql import types as T

# an instant on the wire: UTC, with no fraction or one to nine digits of it
INSTANT = r"^\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$"

# wire name -> column name, in wire order
WIRE = {
    "eventId": "event_id",
    "matchId": "match_id",
    "inning": "inning",
    "over": "over_no",
    "ball": "ball",
    "team": "team",
    "runs": "runs",
    "extras": "extras",
    "wicket": "wicket",
    "totalRuns": "total_runs",
    "wickets": "wickets",
    "timestamp": "ts",
}

_TYPES = {
    "event_id": T.StringType(),
    "match_id": T.StringType(),
    "team": T.StringType(),
    "wicket": T.BooleanType(),
    "ts": T.TimestampNTZType(),
}

WIRE_SCHEMA = T.StructType(
    [T.StructField(wire, _TYPES.get(col, T.IntegerType())) for wire, col in WIRE.items()]
)
BALL_COLUMNS = list(WIRE.values())

HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)
LOG_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("headers", HEADERS),
    ]
)
LOG_ORDER = ["partition", "offset"]
BALL_KEY = ["match_id", "event_sequence"]
