"""The anomaly stream against the same rule in plain Python."""

from datetime import datetime, timedelta
from statistics import mean, stdev

import pytest

from creaseline.streaming.anomalies import ALERT, FEWEST, HIGH, RECENT, TRAILING, AnomalyStream

START = datetime(2024, 5, 1)
MINUTES = 5


def plain(rows):
    counts: dict = {}
    for host, ts in rows:
        if ts is not None:
            at = int((ts - START) / timedelta(minutes=MINUTES))
            counts.setdefault(host, {}).setdefault(at, 0)
            counts[host][at] += 1
    out = set()
    for host, steps in counts.items():
        done = []
        for at in sorted(steps):
            last = [n for _, n, _ in done[-TRAILING:]]
            high = len(last) >= FEWEST and steps[at] > mean(last) + HIGH * stdev(last)
            done.append((at, steps[at], high))
            recent = sum(h for a, _, h in done if a > at - RECENT)
            out.add((host, at, steps[at], high, recent, recent > ALERT))
    return out


@pytest.fixture(scope="module")
def rows():
    out = []
    for at in range(60):
        for host, n in [("a", 3 + at % 3 + (20 if at in (30, 34, 36) else 0)), ("b", 2 if at % 7 else 0), (None, 1 + (9 if at == 50 else 0))]:
            out += [(host, START + timedelta(minutes=MINUTES * at, seconds=(i * 37) % 290)) for i in range(n)]
    return [*out, ("a", None)]


def test_a_stream_that_is_reopened_equals_the_rule(spark, rows, tmp_path):
    frame = lambda part: spark.createDataFrame(part, "host string, ts timestamp")
    late = sorted(rows, key=lambda r: (r[1] is None, r[1] or START))
    half = len(late) // 2
    # rows of the last minutes of the first half come after it, and within the bound
    cut = late[half][1]
    held = [r for i, r in enumerate(late[:half]) if i % 5 == 0 and cut - r[1] < timedelta(minutes=9)]
    first = [r for r in late[:half] if r not in held]
    root = str(tmp_path / "anomalies")
    AnomalyStream(spark, "5 minutes", root=root).consume([frame(first)])
    stream = AnomalyStream(spark, "5 minutes", root=root).consume([frame(held), frame(late[half:])])
    before = stream.read().count()
    stream.close_all()
    got = [(r.host, (r.period - int((START - datetime(1970, 1, 1)).total_seconds())) // (60 * MINUTES), r.n, r.anomaly, r.recent, r.alert) for r in stream.read().collect()]
    want = plain([*first, *held, *late[half:]])
    assert len(got) == len(set(got)) and set(got) == want and before < len(got)
    assert {a for h, a, _, high, *_ in got if high and h == "a"} >= {30} and any(r[-1] for r in got)


def test_nothing_arrived(spark, tmp_path):
    stream = AnomalyStream(spark, "5 minutes", root=str(tmp_path / "none"))
    assert stream.close_all().read().count() == 0
