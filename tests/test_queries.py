"""Every registered query against its SQL, and the ordered ones again with keys cut over many slots."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare, oracle

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Families whose results rest on ordered per-key computations.
HOT = [
    "s1_topic_scan",
    "k2_first_write_wins",
    "k6_replay_publish",
    "a1_live_score",
    "a3_latency_percentiles",
    "a15_group_list",
    "f10_nested_same_element",
    "j8_colocated_join",
    "j9_fetch_join",
    "p24_next_sequence",
    "w1_running_total",
    "w3_view_history",
    "w5_audit_history",
    "w6_rate_check",
    "w10_state_at_revision",
]


@pytest.fixture(scope="module")
def con(data) -> duckdb.DuckDBPyConnection:
    return oracle(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert all(name == name.lower() for name in QUERIES)


@pytest.mark.parametrize("key", [k for k in QUERIES if k in ORACLES])
def test_query_matches_sql(spark, data, con, key):
    df = QUERIES[key](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    problems = compare(df, con, ORACLES[key])
    # small data may leave a result empty on both sides
    assert [p for p in problems if p != "empty result"] == []


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in ORACLES])
def test_query_without_sql_gives_rows(spark, data, key):
    assert QUERIES[key](spark, data).count() > 0


@pytest.mark.parametrize("key", HOT)
def test_query_with_keys_over_many_slots(spark, data, con, many_slots, key):
    problems = compare(QUERIES[key](spark, data), con, ORACLES[key])
    assert [p for p in problems if p != "empty result"] == []


@pytest.mark.parametrize(
    ("key", "pushed"),
    [
        ("s5_match_events", "EqualTo(match_id,"),
        ("s6_point_get", "EqualTo(match_id,"),
        ("s7_index_match_time", "EqualTo(match_id,"),
        ("s7_index_event_id", "EqualTo(event_id,"),
        ("f3_prefix_filter", "StringStartsWith(event_sequence,"),
        ("f4_over_lookup", "GreaterThanOrEqual(event_sequence,"),
        ("f14_unexpired", "GreaterThan(ttl,"),
        ("t2_term_postings", "EqualTo(term,"),
        ("t9_prefix_suggestions", "EqualTo(prefix,"),
    ],
)
def test_reads_of_the_store_reach_its_files(spark, data, key, pushed):
    plan = QUERIES[key](spark, data)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and pushed in scans[0].partition("PushedFilters:")[2]


def test_laid_out_joins_leave_no_tables(spark, data):
    QUERIES["j8_colocated_join"](spark, data).count()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("colocated_")] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
