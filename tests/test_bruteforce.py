"""Operators with feedback, against a plain sequential program on skewed small input."""

import datetime as dt
import random
from collections import deque

import pytest

from creaseline.operators import transfers, windows

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def requests(spark):
    """One client sends a third of all requests."""
    rng = random.Random(3)
    rows, ms = [], 0
    for i in range(900):
        ms += rng.choice([0, 1, 50, 400, 900, 4000, 15000])
        client = 0 if i % 3 == 0 else rng.randrange(1, 9)
        rows.append((client, START + dt.timedelta(milliseconds=ms), ms))
    return rows, spark.createDataFrame([r[:2] for r in rows], "client_id int, ts timestamp_ntz")


def allowed_by_ms(out):
    return {(r.client, r.ms - int((START - dt.datetime(1970, 1, 1)).total_seconds() * 1000)): r.allowed for r in out.collect()}


def tally(rows, decide):
    want = {}
    for client, _, ms in rows:
        passed = decide(client, ms)
        want[(str(client), ms)] = want.get((str(client), ms), 0) + int(passed)
    return want


@pytest.mark.parametrize("hot", [False, True])
def test_sliding_log(spark, requests, hot, request):
    if hot:
        request.getfixturevalue("many_slots")
    rows, df = requests
    logs = {}

    def decide(client, ms):
        log = logs.setdefault(client, deque())
        while log and log[0] <= ms - 60_000:
            log.popleft()
        if len(log) >= 5:
            return False
        log.append(ms)
        return True

    out = windows.sliding_log_check(df, "client_id", "ts", 60_000, 5)
    assert allowed_by_ms(out) == tally(rows, decide)


@pytest.mark.parametrize("hot", [False, True])
def test_token_bucket(spark, requests, hot, request):
    if hot:
        request.getfixturevalue("many_slots")
    rows, df = requests
    buckets = {}

    def decide(client, ms):
        tokens, refilled = buckets.get(client, (4, ms))
        tokens = min(4, tokens + (ms - refilled) // 10_000)
        if tokens < 1:
            return False
        buckets[client] = (tokens - 1, ms)
        return True

    out = windows.token_bucket_check(df, "client_id", "ts", capacity=4, rate=1, period_ms=10_000)
    assert allowed_by_ms(out) == tally(rows, decide)


@pytest.mark.parametrize("hot", [False, True])
def test_guarded_transfers(spark, hot, request):
    if hot:
        request.getfixturevalue("many_slots")
    rng = random.Random(11)
    balances = {a: rng.randrange(-50, 300) for a in range(20)}
    moves = []
    for seq in range(150):
        src = 0 if seq % 3 == 0 else rng.randrange(20)
        dst = rng.choice([a for a in range(20) if a != src])
        moves.append((seq, src, dst, rng.randrange(1, 120)))
    accounts = spark.createDataFrame(list(balances.items()), "account long, balance long")
    df = spark.createDataFrame(moves, "seq long, src long, dst long, amount long")
    got = {r.seq: r.passed for r in transfers.guarded_transfers(accounts, df).collect()}
    for seq, src, dst, amount in moves:
        passed = balances[src] >= amount
        if passed:
            balances[src] -= amount
            balances[dst] += amount
        assert got[seq] == passed, seq


def test_later_rounds_of_transfers_are_small(spark, monkeypatch):
    """A chain that waits for each other takes rounds, but what is settled by then is not dealt again."""
    dealt, spread = [], transfers.spread

    def counted(legs, keys, order):
        dealt.append(legs.count())
        return spread(legs, keys, order)

    monkeypatch.setattr(transfers, "spread", counted)
    # accounts 1000.. pay account 500 at once; 0 to 8 hand on what they are given, each in two halves
    moves = [(i, 1000 + i, 500, 5) for i in range(200)]
    moves += [(200 + 2 * i + j, i, i + 1, 50) for i in range(8) for j in (0, 1)]
    balances = {1000 + i: 10 * (i % 2) for i in range(200)} | {0: 100} | {i: 0 for i in range(1, 9)} | {500: 0}
    accounts = spark.createDataFrame(list(balances.items()), "account long, balance long")
    df = spark.createDataFrame([*moves, (999, 0, 500, None)], "seq long, src long, dst long, amount long")
    got = {r.seq: (r.src, r.dst, r.amount, r.passed) for r in transfers.guarded_transfers(accounts, df).collect()}
    wanted = {}
    for seq, src, dst, amount in moves:
        passed = balances[src] >= amount
        balances[src] -= amount * passed
        balances[dst] += amount * passed
        wanted[seq] = (src, dst, amount, passed)
    assert got == wanted
    assert len(dealt) > 3 and sum(dealt[1:]) < dealt[0]
