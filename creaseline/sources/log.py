"""Log records: reading, headers, decoding with an unreadable split, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from creaseline.functions.scalars import header, instant, instant_text
from creaseline.schemas import LOG_SCHEMA, WIRE, WIRE_SCHEMA

TOPIC = "ball-events"
# Header names of a dead letter.
DLT_HEADERS = {
    "error_message": "kafka_dlt-exception-message",
    "error_fqcn": "kafka_dlt-exception-fqcn",
    "original_topic": "kafka_dlt-original-topic",
    "original_offset": "kafka_dlt-original-offset",
}


def encode(names: dict[str, str] = WIRE) -> Column:
    """JSON text of a ball: nulls omitted, instants in ISO-8601 UTC."""
    fields = F.struct(
        *[(instant_text(F.col(col)) if col == "ts" else F.col(col)).alias(wire) for wire, col in names.items()]
    )
    return F.to_json(fields, {"ignoreNullFields": "true"})


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def to_log(df: DataFrame, trace: Column, topic: str = TOPIC) -> DataFrame:
    """Publish form: key = match, JSON value, three headers. An absent trace becomes empty bytes."""
    pairs = {"X-Trace-Id": trace, "X-Match-Id": F.col("match_id"), "X-Event-Id": F.col("event_id")}
    headers = F.array(*[F.struct(F.lit(n).alias("key"), _bytes(v).alias("value")) for n, v in pairs.items()])
    return df.withColumns(
        {"topic": F.lit(topic), "key": F.col("match_id"), "value": encode(), "headers": headers}
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """File-stream form of a topic; a broker source has the same columns."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def from_broker(df: DataFrame) -> DataFrame:
    """A broker's columns as the log's: binary key and value become text, the time loses its zone."""
    casts = {"key": "string", "value": "string", "partition": "int", "offset": "bigint", "topic": "string"}
    text = [F.col(c).cast(k).alias(c) for c, k in casts.items()]
    time = F.to_utc_timestamp("timestamp", F.current_timezone()).cast("timestamp_ntz").alias("timestamp")
    headers = F.col("headers").cast(LOG_SCHEMA["headers"].dataType).alias("headers")
    return df.select(*text, time, headers).select(*LOG_SCHEMA.fieldNames())


def broker_log(spark: SparkSession, servers: str, topic: str, max_offsets: int) -> DataFrame:
    """Topic scan where the broker connector is on the class path, in the log's columns."""
    return from_broker(
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("kafka.isolation.level", "read_committed")
        .option("maxOffsetsPerTrigger", max_offsets)
        .option("includeHeaders", "true")
        .load()
    )


def parsed(df: DataFrame, unknown_fields: str = "poison") -> DataFrame:
    """Add ``body`` (decoded struct) and ``is_poison``.

    A record is unreadable when it is empty or not a JSON object of the known types, and by default
    also when it carries a field outside the schema. Its instant may have any number of fraction
    digits up to nine. A null value is no JSON error: it decodes to nothing and fails when it is stored.
    """
    # the instant is read as text, since a format string takes one number of digits only
    fields = [T.StructField(f.name, T.StringType()) if f.name == "timestamp" else f for f in WIRE_SCHEMA]
    body = F.from_json(
        "value",
        T.StructType([*fields, T.StructField("_corrupt", T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    keys = F.json_object_keys("value")
    if unknown_fields == "poison":
        unknown = F.array_size(F.array_except(keys, F.array(*[F.lit(w) for w in WIRE])))
    elif unknown_fields == "ignore":
        unknown = F.when(keys.isNotNull(), 0)
    else:
        raise ValueError(f"unknown_fields must be 'poison' or 'ignore', not {unknown_fields!r}")
    # The parsers are the cost of this operator. A projected column would be computed again in every
    # filter pushed below it; the output of a generator is computed once.
    once = F.explode(F.array(F.struct(body.alias("body"), unknown.alias("unknown")))).alias("_parsed")
    text = F.col("_parsed.body.timestamp")
    # a value that is no object has no keys
    bad = (
        F.col("_parsed.body._corrupt").isNotNull()
        | (F.coalesce("_parsed.unknown", F.lit(1)) > 0)
        | (text.isNotNull() & instant(text).isNull())
    )
    body = F.col("_parsed.body").withField("timestamp", instant(text)).alias("body")
    return df.select("*", once).select(*df.columns, body, (F.col("value").isNotNull() & bad).alias("is_poison"))


def ball_fields() -> list[Column]:
    """Ball columns of a decoded body."""
    return [F.col(f"body.{wire}").alias(col) for wire, col in WIRE.items()]


def decode(df: DataFrame, unknown_fields: str = "poison") -> tuple[DataFrame, DataFrame]:
    """Split a log into decoded balls (plus log columns) and unreadable records."""
    both = parsed(df, unknown_fields)
    rest = [c for c in df.columns if c not in ("value", "key", "topic", "headers", "timestamp")]
    ok = both.where(~F.col("is_poison")).select(*rest, *ball_fields())
    poison = both.where("is_poison").select(*df.columns)
    return ok, poison


def dead_letter_rows(df: DataFrame) -> DataFrame:
    """Dead-letter log with its error headers as columns; absent headers are null."""
    return df.select("*", *[header(h).alias(c) for c, h in DLT_HEADERS.items()])


def to_dead_letters(df: DataFrame, error_fqcn: Column, error_message: Column, topic: str = TOPIC + "-dlt") -> DataFrame:
    """Dead-letter envelope: key and value kept, error headers appended."""
    extra = {
        "error_message": error_message,
        "error_fqcn": error_fqcn,
        "original_topic": F.col("topic"),
        "original_offset": F.col("offset").cast("string"),
    }
    added = F.array(
        *[F.struct(F.lit(DLT_HEADERS[c]).alias("key"), _bytes(v).alias("value")) for c, v in extra.items()]
    )
    headers = F.coalesce("headers", F.array().cast(df.schema["headers"].dataType))
    return df.withColumns({"headers": F.concat(headers, added), "topic": F.lit(topic)})
