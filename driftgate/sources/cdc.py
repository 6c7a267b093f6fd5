"""Change-stream sources and the envelope they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.changes import decode_op, event_identity, op_is_unknown

_SOURCE = "struct<gtid:string,db:string,`table`:string,ts_ms:bigint>"
_BODY = f"op:string,before:map<string,string>,after:map<string,string>,source:{_SOURCE}"
ENVELOPE = f"struct<{_BODY},payload:struct<{_BODY}>,_bad:string>"


def read_cdc_kafka(
    spark: SparkSession, servers: str, prefix: str, streaming: bool = True, per_trigger: int | None = None, **options
) -> DataFrame:
    """All table topics under ``prefix`` (needs the public Kafka connector package)."""
    reader = spark.readStream if streaming else spark.read
    reader = (
        reader.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", rf"{prefix}\.[^.]+\..+").option("startingOffsets", "earliest")
        .option("failOnDataLoss", "true")
    )
    if streaming and per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(
        "topic", "partition", "offset", F.col("value").cast("string").alias("value")
    )


RAW_SCHEMA = "topic string, partition int, offset bigint, value string"


def read_cdc_files(spark: SparkSession, folder: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """The same raw records exported as JSON lines: topic, partition, offset, value."""
    reader = (spark.readStream if streaming else spark.read).schema(RAW_SCHEMA)
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def parse_cdc(raw: DataFrame, envelope: str = ENVELOPE) -> DataFrame:
    """Envelope fields of each record, tagged event, tombstone or corrupt.

    One ``from_json`` reads both shapes (with and without ``payload``); row
    images become maps of text. Pass another ``envelope`` with struct images to
    parse a known table straight into types. The one-element explode keeps the
    optimizer from copying the parse into every filter and column above it.
    """
    document = F.from_json("value", envelope, {"columnNameOfCorruptRecord": "_bad"})
    parsed = raw.select("topic", "partition", "offset", "value", F.explode(F.array(document)).alias("_j"))
    wrapped = F.col("_j.payload").isNotNull()

    def field(name: str) -> Column:
        return F.when(wrapped, F.col(f"_j.payload.{name}")).otherwise(F.col(f"_j.{name}"))

    op = field("op")
    status = (
        F.when(F.col("value").isNull() | (F.trim("value") == "") | (F.trim("value") == "null"), "tombstone")
        .when(F.col("_j._bad").isNotNull() | F.col("_j").isNull(), "corrupt")
        .otherwise("event")
    )
    gtid, ts_ms = field("source.gtid"), field("source.ts_ms")
    return parsed.select(
        "topic", "partition", "offset", "value", status.alias("status"),
        event_identity(gtid, ts_ms, F.col("topic"), F.col("partition"), F.col("offset")).alias("gtid"),
        F.coalesce(field("source.db"), F.lit("")).alias("db"),
        F.coalesce(field("source.table"), F.lit("")).alias("table_name"),
        decode_op(op).alias("op"), op_is_unknown(op).alias("op_unknown"),
        field("before").alias("before"), field("after").alias("after"),
        F.coalesce(ts_ms, F.lit(0)).alias("ts_ms"),
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("status = 'event'").drop("status", "value")


def dead_letters(parsed: DataFrame, failed_at: Column | None = None, reason: str = "unparsable event") -> DataFrame:
    """Records that could not be read, with where they came from and why.

    Tombstones are not failures; they are dropped by design.
    """
    moment = F.current_timestamp() if failed_at is None else failed_at
    return parsed.where("status = 'corrupt'").select(
        F.col("topic").alias("original_topic"), F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"), F.col("value").alias("original_value"),
        F.lit(reason).alias("failure_reason"), moment.alias("failed_at"),
    )


def split_dlq(raw: DataFrame, failed_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Readable events and dead letters of the same records."""
    parsed = parse_cdc(raw)
    return good_events(parsed), dead_letters(parsed, failed_at)


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Records not yet consumed per topic from (topic, partition, end_offset, committed_offset)."""
    behind = F.greatest(F.lit(0), F.col("end_offset") - F.coalesce("committed_offset", F.lit(0)))
    return offsets.groupBy("topic").agg(F.sum(behind).cast("bigint").alias("lag_records"))


def retention_guard(events: DataFrame, now_ms: int, alert_days: float = V.RETENTION_ALERT_DAYS) -> DataFrame:
    """How far each topic is behind, and whether that nears the broker's retention."""
    newest = events.groupBy("topic").agg(F.max("ts_ms").alias("newest_ts_ms"))
    lag = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col("newest_ts_ms")) / F.lit(1000.0))
    return newest.select(
        "topic", F.round(lag, 2).alias("lag_seconds"), (lag >= alert_days * 86400).alias("retention_at_risk")
    )
