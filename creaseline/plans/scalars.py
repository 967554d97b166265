"""P: projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.functions.scalars import (
    event_sequence,
    java_hash,
    ratio_percent,
    string_shard,
    ttl,
)
from creaseline.operators import chunks, ingest, sharding, writes
from creaseline.operators.view import VIEW_COLUMNS, score_lines
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_BALLS, SQL_LOG, SQL_VIEW
from creaseline.plans.registry import query
from creaseline.plans.sources import STORED_SQL, TTL_SQL, store
from creaseline.sources.log import encode
from creaseline.sources.tables import table

AS_OF = "2001-08-01 10:45:00"


@query(
    "p1_event_sequence",
    SQL_BALLS + "SELECT event_id, printf('%d#%02d#%d', inning, over_no, ball) AS event_sequence FROM balls",
)
def sequence(spark, folder):
    return inputs.balls(spark, folder).select("event_id", event_sequence().alias("event_sequence"))


def partial_requests(spark, folder):
    """Balls of which some lack their id or timestamp."""
    rows = inputs.balls(spark, folder)
    return rows.withColumns(
        {
            "event_id": F.when(F.col("src_id") % 5 != 0, F.col("event_id")),
            "ts": F.when(F.col("src_id") % 3 != 0, F.col("ts")),
        }
    )


@query(
    "p2_with_defaults",
    SQL_BALLS
    + """ SELECT src_id, CASE WHEN src_id % 5 <> 0 THEN event_id END AS given_id, src_id % 5 = 0 AS generated_id,
    CASE WHEN src_id % 3 <> 0 THEN ts END AS given_ts, true AS complete FROM balls""",
)
def defaults(spark, folder):
    rows = partial_requests(spark, folder).select("src_id", "event_id", "ts")
    kept = rows.withColumns({"given_id": F.col("event_id"), "given_ts": F.col("ts")})
    filled = ingest.with_defaults(kept)
    is_uuid = F.col("event_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return filled.select(
        "src_id",
        "given_id",
        is_uuid.alias("generated_id"),
        "given_ts",
        (F.col("ts").isNotNull() & F.coalesce(F.col("given_id") == F.col("event_id"), F.lit(True))).alias("complete"),
    )


@query(
    "p3_request_to_event",
    SQL_BALLS
    + """SELECT src_id, match_id, printf('%d#%02d#%d', inning, over_no, ball) AS event_sequence, runs,
    true AS new_id, true AS new_ts FROM balls""",
)
def request_to_event(spark, folder):
    sent = inputs.balls(spark, folder).withColumns({"sent_id": F.col("event_id"), "sent_ts": F.col("ts")})
    return ingest.from_request(sent).select(
        "src_id",
        "match_id",
        "event_sequence",
        "runs",
        (F.col("event_id") != F.col("sent_id")).alias("new_id"),
        (F.col("ts") != F.col("sent_ts")).alias("new_ts"),
    )


@query("p4_json_encode", SQL_LOG + "SELECT event_id, json AS value FROM log WHERE kind = 0")
def json_encode(spark, folder):
    return inputs.balls(spark, folder).select("event_id", encode().alias("value"))


@query("p5_store_row", SQL_ACCEPTED + f"SELECT {STORED_SQL}, ts AS event_ts, {TTL_SQL} FROM accepted")
def store_row(spark, folder):
    return store(spark, folder)


@query("p6_ttl", f"SELECT event_id, {TTL_SQL} FROM events")
def time_to_live(spark, folder):
    return table(spark, folder, "events").select("event_id", ttl(F.col("ts")).alias("ttl"))


@query(
    "p7_live_row",
    SQL_BALLS
    + """SELECT event_id, match_id, total_runs, wickets, inning AS current_inning, over_no AS current_over,
    ball AS current_ball, runs AS last_ball_runs, wicket AS is_wicket, ts AS last_updated FROM balls""",
)
def live_row(spark, folder):
    renamed = [F.col(src).alias(dst) for dst, src in VIEW_COLUMNS.items()]
    return inputs.balls(spark, folder).select("event_id", "match_id", *renamed)


@query(
    "p8_score_line",
    SQL_VIEW
    + """SELECT match_id, CASE WHEN current_inning = 1 THEN 'A' ELSE 'B' END || ' ' || total_runs || '/' || wickets
    || ' (' || current_over || '.' || current_ball || ')' AS score_line FROM live""",
)
def score_line(spark, folder):
    return score_lines(inputs.view(spark, folder))


def raw_requests(spark, folder):
    """Requests of which some break rules, several of them more than one."""
    n = F.col("src_id")
    broken = {
        "match_id": F.when(n % 19 == 0, "  ").when(n % 43 == 0, F.lit(None)).otherwise(F.col("match_id")),
        "inning": F.when(n % 11 == 0, 3).otherwise(F.col("inning")),
        "over_no": F.when(n % 13 == 0, 25).otherwise(F.col("over_no")),
        "ball": F.when(n % 17 == 0, 0).otherwise(F.col("ball")),
        "runs": F.when(n % 23 == 0, 7).otherwise(F.col("runs")),
        "extras": F.when(n % 29 == 0, -1).otherwise(F.col("extras")),
        "wicket": F.when(n % 37 != 0, F.col("wicket")),
        "total_runs": F.when(n % 41 != 0, F.col("total_runs")),
    }
    return inputs.balls(spark, folder).withColumns(broken)


SQL_REQUESTS = (
    SQL_BALLS
    + """, requests AS (SELECT event_id, src_id,
  CASE WHEN src_id % 19 = 0 THEN '  ' WHEN src_id % 43 = 0 THEN NULL ELSE match_id END AS match_id,
  CASE WHEN src_id % 11 = 0 THEN 3 ELSE inning END AS inning, CASE WHEN src_id % 13 = 0 THEN 25 ELSE over_no END AS over_no,
  CASE WHEN src_id % 17 = 0 THEN 0 ELSE ball END AS ball, team, CASE WHEN src_id % 23 = 0 THEN 7 ELSE runs END AS runs,
  CASE WHEN src_id % 29 = 0 THEN -1 ELSE extras END AS extras, CASE WHEN src_id % 37 <> 0 THEN wicket END AS wicket,
  CASE WHEN src_id % 41 <> 0 THEN total_runs END AS total_runs, wickets FROM balls),
errors AS (
  SELECT event_id, 'matchId' AS field, 'matchId must not be blank' AS message, match_id AS rejected_value FROM requests WHERE match_id IS NULL OR trim(match_id) = ''
  UNION ALL SELECT event_id, 'inning', 'inning must be 1 or 2', CAST(inning AS VARCHAR) FROM requests WHERE inning NOT IN (1, 2)
  UNION ALL SELECT event_id, 'over', 'over must be between 0 and 19', CAST(over_no AS VARCHAR) FROM requests WHERE over_no NOT BETWEEN 0 AND 19
  UNION ALL SELECT event_id, 'ball', 'ball must be at least 1', CAST(ball AS VARCHAR) FROM requests WHERE ball < 1
  UNION ALL SELECT event_id, 'ball', 'ball must be at most 9 (including extras)', CAST(ball AS VARCHAR) FROM requests WHERE ball > 9
  UNION ALL SELECT event_id, 'runs', 'runs must be >= 0', CAST(runs AS VARCHAR) FROM requests WHERE runs < 0
  UNION ALL SELECT event_id, 'runs', 'runs must be <= 6', CAST(runs AS VARCHAR) FROM requests WHERE runs > 6
  UNION ALL SELECT event_id, 'extras', 'extras must be >= 0', CAST(extras AS VARCHAR) FROM requests WHERE extras < 0
  UNION ALL SELECT event_id, 'wicket', 'wicket must not be null', NULL FROM requests WHERE wicket IS NULL
  UNION ALL SELECT event_id, 'totalRuns', 'totalRuns must not be null', NULL FROM requests WHERE total_runs IS NULL
  UNION ALL SELECT event_id, 'wickets', 'wickets must be <= 10', CAST(wickets AS VARCHAR) FROM requests WHERE wickets > 10)"""
)


@query(
    "p9_response_shape",
    SQL_REQUESTS
    + """SELECT CASE WHEN n IS NULL THEN r.event_id END AS event_id, match_id,
    CASE WHEN n IS NULL THEN 202 ELSE 400 END AS status,
    CASE WHEN n IS NULL THEN 'Score event accepted for publishing'
         ELSE 'Request body validation failed with ' || n || ' error(s)' END AS message
    FROM requests r LEFT JOIN (SELECT event_id, count(*) AS n FROM errors GROUP BY 1) e ON e.event_id = r.event_id""",
)
def response_shape(spark, folder):
    return ingest.responses(ingest.with_errors(raw_requests(spark, folder)))


@query("p10_column_subset", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def column_subset(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "p11_case_buckets",
    """SELECT event_id, CASE WHEN k < 18 THEN 'MINOR' WHEN k < 65 THEN 'ADULT' ELSE 'SENIOR' END AS category
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
)
def case_buckets(spark, folder):
    age = F.get_json_object("props", "$.k").cast("int")
    category = F.when(age < 18, "MINOR").when(age < 65, "ADULT").otherwise("SENIOR")
    return table(spark, folder, "events").select("event_id", category.alias("category"))


@query("p12_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_path(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.absent").alias("absent")
    )


@query(
    "p13_row_to_json",
    """SELECT p_partkey, CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand, 'p_size': p_size}) AS VARCHAR) AS doc FROM part""",
)
def row_to_json(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return rows.select("p_partkey", F.to_json(F.struct("*")).alias("doc"))


@query("p14_map_upper_length", "SELECT p_partkey, upper(p_name) AS upper_name, CAST(length(p_name) AS INTEGER) AS name_length FROM part")
def map_upper_length(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.length("p_name").alias("name_length")
    )


@query(
    "p15_flat_map_words",
    """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents)
    WHERE word <> '' GROUP BY word""",
)
def flat_map_words(spark, folder):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    words = table(spark, folder, "documents").select(F.explode(F.split(text, " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p16_safe_ratio",
    """SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN l_linenumber > 1
    THEN l_quantity / ((l_linenumber - 1) * 6) * 100 ELSE 0.0 END, 6) AS strike_rate FROM lineitem""",
)
def safe_ratio(spark, folder):
    balls = (F.col("l_linenumber") - 1) * 6
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.round(ratio_percent(F.col("l_quantity"), balls), 6).alias("strike_rate"),
    )


@query(
    "p17_date_rounding",
    f"""SELECT o_orderkey, o_orderdate >= date_trunc('day', TIMESTAMP '{AS_OF}' - INTERVAL 1 YEAR) AS in_last_year,
    o_orderdate >= date_trunc('hour', TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS in_last_day,
    'orders_' || year(o_orderdate) || '_q' || quarter(o_orderdate) AS quarter_name FROM orders""",
)
def date_rounding(spark, folder):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    year_ago = F.date_trunc("day", as_of - F.expr("INTERVAL 1 YEAR")).cast("timestamp_ntz")
    day_ago = F.date_trunc("hour", as_of - F.expr("INTERVAL 24 HOURS")).cast("timestamp_ntz")
    quarter = F.concat(F.lit("orders_"), F.year("o_orderdate"), F.lit("_q"), F.quarter("o_orderdate"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderdate") >= year_ago).alias("in_last_year"),
        (F.col("o_orderdate") >= day_ago).alias("in_last_day"),
        quarter.alias("quarter_name"),
    )


@query("p18_modulus_shard", "SELECT c_custkey, CAST(c_custkey % 3 AS INTEGER) AS shard FROM customer")
def modulus_shard(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("shard"))


def hash_sql(text: str) -> str:
    unsigned = (
        f"list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT)), "
        "lambda h, c: (h * 31 + c) % 4294967296)"
    )
    return f"(CASE WHEN {unsigned} >= 2147483648 THEN {unsigned} - 4294967296 ELSE {unsigned} END)"


@query(
    "p18_string_hash_shard",
    f"SELECT c_custkey, h AS hash, CAST(abs(h) % 192 AS INTEGER) AS shard FROM (SELECT c_custkey, {hash_sql('c_name')} AS h FROM customer)",
)
def string_hash_shard(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", java_hash(F.col("c_name")).alias("hash"), string_shard(F.col("c_name"), 192).alias("shard")
    )


def md5_sql(text: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5({text}), 1, 16)) AS UBIGINT) AS HUGEINT)"


@query(
    "p19_consistent_hash_ring",
    f"""WITH signed AS (
      SELECT 'shard' || s AS shard, {md5_sql("'shard' || s || '#' || i")} AS u FROM range(3) a(s), range(150) b(i)),
    ring AS (SELECT shard, CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS pos FROM signed),
    raw_keys AS (SELECT c_custkey, {md5_sql("c_name")} AS u FROM customer),
    keys AS (SELECT c_custkey, CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS pos FROM raw_keys)
    SELECT c_custkey, coalesce(r.shard, (SELECT arg_min(shard, pos) FROM ring)) AS shard
    FROM keys k ASOF LEFT JOIN ring r ON k.pos <= r.pos""",
)
def consistent_hash_ring(spark, folder):
    keys = table(spark, folder, "customer").select("c_custkey", "c_name")
    return sharding.ring_lookup(keys, F.col("c_name"), ["shard0", "shard1", "shard2"]).drop("c_name")


@query(
    "p20_salted_key",
    """SELECT event_type, count(DISTINCT event_id % 10) AS salts, count(*) AS n,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM events GROUP BY 1""",
)
def salted_key(spark, folder):
    measures = {"n": F.lit(1), "total": F.col("value").cast("decimal(18,2)")}
    return sharding.salted_totals(table(spark, folder, "events"), "event_type", F.col("event_id"), measures)


@query(
    "p21_variant_assignment",
    f"""SELECT c_custkey, abs({hash_sql('c_name')}) % 100 < 50 AS included,
    CASE WHEN abs({hash_sql("c_name || 'exp-1'")}) % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM customer""",
)
def variant_assignment(spark, folder):
    included, variant = sharding.variant(F.col("c_name"), "exp-1", 0.5)
    return table(spark, folder, "customer").select("c_custkey", included.alias("included"), variant.alias("variant"))


@query(
    "p22_ingest_enrichment",
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp_ms(epoch_us(ts) // 1000) AS event_ts, lower(event_type || '-CITY') AS city FROM events""",
)
def ingest_enrichment(spark, folder):
    raw = table(spark, folder, "events").select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.concat("event_type", F.lit("-CITY")).alias("city"),
    )
    return raw.select(
        "event_id", "ms", F.timestamp_millis("ms").cast("timestamp_ntz").alias("event_ts"), F.lower("city").alias("city")
    )


@query(
    "p23_payload_chunks",
    """SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, doc_id || '#' || chunk_no AS chunk_id,
    substr(text, chunk_no * 1000 + 1, 1000) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil(length(text) / 1000.0), 1) AS BIGINT))) AS chunk_no FROM documents)""",
)
def payload_chunks(spark, folder):
    return chunks.split_payload(table(spark, folder, "documents"), "doc_id", "text", 1000)


@query("p23_reassemble", "SELECT doc_id, text FROM documents")
def reassemble(spark, folder):
    pieces = chunks.split_payload(table(spark, folder, "documents"), "doc_id", "text", 1000)
    return chunks.join_payload(pieces, "doc_id", "text")


@query(
    "p24_next_sequence",
    """WITH stored AS (SELECT o_custkey, count(*) AS last_seq FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1)
    SELECT o_orderkey, o_custkey, coalesce(last_seq, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq
    FROM orders LEFT JOIN stored USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '1999-01-01'""",
)
def next_sequence(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    stored = orders.where(F.col("o_orderdate") < cut).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("last_seq"))
    new = orders.where(F.col("o_orderdate") >= cut).drop("o_orderdate")
    return writes.number_rows(new, ["o_custkey"], ["o_orderkey"], stored)


@query("p24_prefixed_id", "SELECT c_custkey, 'USR' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS user_ref FROM customer")
def prefixed_id(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.format_string("USR%08d", "c_custkey").alias("user_ref"))
