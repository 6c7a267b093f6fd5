"""Streaming forms run over the whole event log, compared with what a batch query gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import StreamingQueryException

from driftgate.functions.risk_rules import risk_band
from driftgate.operators import anomaly
from driftgate.plans.anomaly_checks import BEATS_SQL, heartbeats
from driftgate.plans.cdc_checks import STEPS_SQL
from driftgate.plans.cdc_inputs import FENCE_SQL, LOG_SQL, MOVED, raw_log, stale_target
from driftgate.plans.compare_checks import CLOCK_START, compared, compared_sql
from driftgate.plans.inputs import edge_orders, target_orders, touched_orders
from driftgate.plans.registry import check, table
from driftgate.plans.risk_checks import DEADLINE, DRAIN_SQL, DRAWS, STATES_SQL, cost_sql, prices, states, writes
from driftgate.session import shared_folder
from driftgate.sources import segments
from driftgate.sources.cdc import RAW_SCHEMA, read_cdc_files
from driftgate.sources.tables import BucketedTable, list_folder, set_time
from driftgate.streaming import apply, carry, drain, live, metrics, watch

_FILE_ROWS = 250_000  # of one task of a batch
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares for checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, folder) -> DataFrame:
    """The event log as a stream; watermarks need a timestamp with a time zone."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _landed(stream: DataFrame) -> DataFrame:
    """Run a stream over everything there is and read back what it wrote."""
    spark = stream.sparkSession
    # operators with several state columns and timers need this store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    place = _scratch(spark)
    query = (
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@check(
    "str3_fence_stream",
    f"""WITH {FENCE_SQL}, fenced AS (SELECT *, coalesce(max(epoch) OVER (PARTITION BY table_name ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS max_seen FROM writes)
        SELECT seq AS write_id, table_name, epoch >= max_seen AS accepted FROM fenced""",
)
def fence_stream(spark, folder) -> DataFrame:
    late = F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    epoch = (1 + F.floor(F.col("event_id") / 2500) - late).cast("bigint")
    writes = _events(spark, folder).select(
        F.col("event_id").alias("seq"), epoch.alias("epoch"), F.col("event_type").alias("table_name"),
        F.lit("u").alias("operation"), F.col("ts").alias("written_at"),
    )
    place = _scratch(spark)
    apply.run_batches(writes, apply.FenceApplier(spark, place, "table_name"), f"{place}/state").awaitTermination()

    def part(name: str, accepted: bool) -> DataFrame:
        return spark.read.parquet(f"{place}/{name}").select("write_id", "table_name", F.lit(accepted).alias("accepted"))

    return part("audit", True).unionByName(part("violations", False))


@check(
    "str2_dedup_stream",
    "SELECT DISTINCT user_id || ':' || event_type || ':' || CAST(floor(value) AS BIGINT) AS event_id FROM events",
)
def dedup_stream(spark, folder) -> DataFrame:
    """Ids that repeat; the horizon covers the month of the log, so each is kept once."""
    identity = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor("value").cast("string"))
    rows = _events(spark, folder).select(identity.alias("event_id"), "ts")
    return _landed(apply.deduplicated(rows, "ts", "40 days")).select("event_id")


@check(
    "str5_band_alerts_stream",
    """WITH b AS (SELECT event_type AS run_id, event_id AS ts_ms, CASE WHEN value * 30 >= 5000 THEN 'BLOCK' WHEN value * 30 >= 4000 THEN 'CAUTION' ELSE 'PROCEED' END AS band FROM events),
       p AS (SELECT *, coalesce(lag(band) OVER (PARTITION BY run_id ORDER BY ts_ms), 'PROCEED') AS previous FROM b)
       SELECT * FROM (SELECT run_id, ts_ms, previous, band, CASE WHEN band = 'BLOCK' AND previous <> 'BLOCK' THEN 'on_block' WHEN band = 'CAUTION' AND previous = 'PROCEED' THEN 'on_caution'
              WHEN band = 'PROCEED' AND previous <> 'PROCEED' THEN 'on_proceed' END AS alert FROM p) WHERE alert IS NOT NULL""",
)
def band_alerts_stream(spark, folder) -> DataFrame:
    """The event log in eight batches or more; the last band of each run is carried between them."""
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("run_id"), F.col("event_id").alias("ts_ms"), risk_band(F.col("value") * 30).alias("band")
    )
    place = _scratch(spark)
    body = carry.band_alerts(spark, place)
    apply.run_batches(_in_files(rows, "ts_ms", least=8), body, f"{place}/state").awaitTermination()
    return body.results()


@check(
    "str7_tumbling_stream",
    """SELECT event_type, (epoch_us(ts) // 3600000000) * 3600000000 AS us, max(value) AS worst, count(*) AS n FROM events GROUP BY 1, 2""",
)
def tumbling_stream(spark, folder) -> DataFrame:
    """Windows that the watermark has closed, and the open ones from a last batch."""
    def build(rows):
        return metrics.tumbling(rows, "ts", "1 hour", {"worst": F.max("value"), "n": F.count(F.lit(1))}, ["event_type"], lateness="1 minute")

    found = _completed(spark, folder, build, 60_000_000)
    return found.select("event_type", F.unix_micros("window_start").alias("us"), "worst", "n")


@check(
    "str8_dead_man_stream",
    """WITH w AS (SELECT event_type, (epoch_us(ts) // 1800000000 - k) * 1800000000 AS us, CAST(CAST(floor(value) AS BIGINT) * 1000000 AS BIGINT) AS gained
               FROM events, (SELECT unnest(range(8)) AS k))
       SELECT event_type, us, CAST(sum(gained) AS BIGINT) AS gained_bytes, count(*) AS checkpoints, count(*) >= 2 AND sum(gained) < 150000000 AS alert
       FROM w GROUP BY 1, 2""",
)
def dead_man_stream(spark, folder) -> DataFrame:
    """Four hours in steps of half an hour, over several batches."""
    def build(rows):
        gains = rows.withColumn("gained", F.floor("value").cast("bigint") * 1_000_000)
        return metrics.dead_man_stream(gains, "ts", "gained", ["event_type"], min_bytes=150_000_000, lateness="10 minutes")

    found = _completed(spark, folder, build, 600_000_000)
    return found.select("event_type", F.unix_micros("window_start").alias("us"), "gained_bytes", "checkpoints", "alert")


def _in_files(rows: DataFrame, order: str | list[str], least: int = 4) -> DataFrame:
    """The same rows as a stream of ``least`` batches or more, in ``order``, so that state is carried from batch to batch.

    The rows are stored once, since Spark reads its input anew for the bounds of ranges, and cut into ranges of about
    ``_FILE_ROWS`` rows, a range a task and a file. A stream takes older files first, so the files get times in the order of
    their ranges. What a batch costs besides its rows must not grow with the table: a longer one has more files a batch, and
    never twice ``least`` batches.
    """
    spark, place = rows.sparkSession, _scratch(rows.sparkSession)
    rows.write.parquet(f"{place}/given")
    given = spark.read.schema(rows.schema).parquet(f"{place}/given")
    ranges = max(least, -(-given.count() // _FILE_ROWS))
    dealt = given.repartitionByRange(ranges, *([order] if isinstance(order, str) else order))
    dealt.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{place}/in")
    number = sorted(int(name.partition("=")[2]) for name in list_folder(spark, f"{place}/in") if name.startswith("_range="))
    for at, k in enumerate(number):
        files = [f"{place}/in/_range={k}/{name}" for name in list_folder(spark, f"{place}/in/_range={k}")]
        set_time(spark, [f for f in files if f.endswith(".parquet")], at - len(number))
    if not number:
        rows.write.mode("append").parquet(f"{place}/in")
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, len(number) // least)).option("recursiveFileLookup", "true")
    return reader.parquet(f"{place}/in")


def _completed(spark, folder, build, lateness_us: int) -> DataFrame:
    """Windows a stream over several batches has closed, and from a batch over the same rows those it must not close yet.

    What the last watermark leaves open is known from the rows alone: windows that end after the latest time less the allowed
    lateness. Every other window has to come from the stream; one that it loses is missing here, and one that it closes too
    early is here twice.
    """
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = _landed(build(_in_files(rows, "ts")))
    newest = rows.agg(F.max(F.unix_millis("ts"))).scalar()
    open_ = F.unix_micros("window_end") > newest * 1000 - lateness_us
    return closed.unionByName(build(rows).where(open_))


@check("str9_scored_stream", f"WITH {BEATS_SQL} SELECT count(*) AS n_rows, count(*) AS same_score, count(*) AS in_range FROM beats")
def scored_stream(spark, folder) -> DataFrame:
    """Scores of a stream of heartbeats are those of a batch with the same model."""
    beats = heartbeats(spark, folder)
    model = anomaly.fit_forest(beats, key="us")
    live = _landed(anomaly.score_rows(_in_files(beats, "us"), model)).select("us", F.col("score").alias("live"))
    both = anomaly.score_rows(beats, model).join(live, "us")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score") == F.col("live")).alias("same_score"),
        F.count_if(F.col("score").between(0, 1)).alias("in_range"),
    )


@check(
    "str10_risk_stream",
    f"""WITH {STATES_SQL}, {cost_sql('st', DRAWS)}, q AS (SELECT state_id, quantile_cont(cost, [0.05, 0.5, 0.95, 0.99]) AS p FROM costs GROUP BY 1)
        SELECT state_id, round(p[3], 2) AS p95_usd, CASE WHEN p[3] >= 5000 THEN 'BLOCK' WHEN p[3] >= 4000 THEN 'CAUTION' ELSE 'PROCEED' END AS recommendation,
               CASE WHEN p[3] >= 5000 THEN 0.0::DOUBLE ELSE round((5000 - p[3]) / (mean_gbps * 0.09::DOUBLE), 0) END AS event_horizon_seconds
        FROM st JOIN q USING (state_id)""",
)
def risk_stream(spark, folder) -> DataFrame:
    """Every batch of live states is evaluated as it arrives."""
    place = _scratch(spark)

    def write(found: DataFrame, batch_id: int) -> None:
        found.write.mode("overwrite").parquet(f"{place}/out/batch_id={batch_id}")

    body = metrics.risk_batches(write, n=DRAWS, method="md5")
    apply.run_batches(_in_files(states(spark, folder), "state_id"), body, f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("state_id", "p95_usd", "recommendation", "event_horizon_seconds")


def _applied(spark, folder) -> tuple[str, BucketedTable]:
    """The change log in three batches or so, with partial images and repeats, and the last batch once more."""
    place = _scratch(spark)
    log = raw_log(spark, folder)
    # all changes of a key, and of the key a change moves it to, stay in one file, since batches follow each other by file
    files = max(1, -(-table(spark, folder, "orders").count() // (3 * _FILE_ROWS)))  # of a batch
    log.repartition(3 * files, F.floor(F.col("offset") / 8) % MOVED).write.json(f"{place}/raw")
    target = stale_target(spark, folder)
    held = BucketedTable(spark, f"{place}/table", "o_orderkey", target.schema, buckets=16)
    held.create(target)
    applier = apply.CdcApplier(spark, held, f"{place}/sink", {f.name: f.dataType.simpleString() for f in target.schema.fields})
    raw = read_cdc_files(spark, f"{place}/raw", streaming=True, files_per_trigger=files)
    apply.run_apply(raw, applier, f"{place}/state").awaitTermination()
    return place, held


@check("str1_apply_stream", f"WITH {LOG_SQL}, {STEPS_SQL} SELECT * FROM applied")
def apply_stream(spark, folder) -> DataFrame:
    place, held = _applied(spark, folder)
    applier = apply.CdcApplier(spark, held, f"{place}/sink", {f.name: f.dataType.simpleString() for f in held.schema.fields})
    applier(spark.read.schema(RAW_SCHEMA).json(f"{place}/raw"), 99)
    return held.read()


@check(
    "snk6_stream_counters",
    f"""WITH {LOG_SQL}, lastone AS (SELECT identity, coalesce(ts_ms, 0) AS t FROM good ORDER BY coalesce(ts_ms, 0) DESC, off DESC LIMIT 1)
        SELECT (SELECT count(DISTINCT event_id) FROM good) AS events_processed, (SELECT count(*) - count(DISTINCT event_id) FROM good) AS events_deduplicated,
               count(*) FILTER (status = 'corrupt') AS events_dlq, count(*) FILTER (status = 'tombstone') AS tombstones,
               (SELECT identity FROM lastone) AS last_gtid, (SELECT t FROM lastone) AS last_event_ts_ms FROM log""",
)
def stream_counters(spark, folder) -> DataFrame:
    """Counters that the batches of the applied stream have left behind."""
    place, _ = _applied(spark, folder)
    return watch.sink_totals(spark, f"{place}/sink").drop("batches")


@check("src6_segment_log", f"""WITH {LOG_SQL} SELECT CAST(part AS INTEGER) AS "partition", off AS "offset", status <> 'tombstone' AS has_value, 1::BIGINT AS times FROM log""")
def segment_log(spark, folder) -> DataFrame:
    """A log read by offsets in batches that end inside its files, with a query that dies half-way and is started again."""
    place, log = _scratch(spark), raw_log(spark, folder)
    rows = log.count()
    segments.write_segments(log, f"{place}/log", rows=max(10, rows // 16))
    stream = segments.read_segments(spark, f"{place}/log", f"{place}/admitted", per_batch=max(7, rows // 28))
    died = []

    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch_id={batch_id}")
        if batch_id == 2 and not died:
            died.append(batch_id)
            raise RuntimeError("driver lost")

    for _ in range(2):
        query = stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{place}/state").start()
        try:
            query.processAllAvailable()
        except StreamingQueryException:
            if not died:
                raise
        query.stop()
    found = spark.read.parquet(f"{place}/out")
    return found.groupBy("partition", "offset", F.col("value").isNotNull().alias("has_value")).agg(F.count(F.lit(1)).alias("times"))


@check(
    "str4_price_buffer_stream",
    f"""WITH {DRAIN_SQL} SELECT event_id AS entry_id, flush_us, flush_price, CASE WHEN flush_us >= us + 7200000000 THEN 'max_age' ELSE 'price_normal' END AS flush_reason FROM drained""",
)
def price_buffer_stream(spark, folder) -> DataFrame:
    """Writes and prices as one stream of several batches; entries wait across batches, the last ones go as planned."""
    left = writes(spark, folder).select(F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"), "table_name", "bytes", F.lit(None).cast("double").alias("price"))
    right = prices(spark, folder).select(
        F.lit(None).cast("bigint").alias("entry_id"), F.col("price_ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("table_name"),
        F.lit(None).cast("bigint").alias("bytes"), "price",
    )
    place = _scratch(spark)
    body = drain.DrainApplier(spark, f"{place}/buffer", deadline_us=DEADLINE)
    apply.run_batches(_in_files(left.unionByName(right), "ts"), body, f"{place}/state").awaitTermination()
    found = body.released().unionByName(body.planned())
    return found.select("entry_id", F.unix_micros("flush_at").alias("flush_us"), "flush_price", "flush_reason")


@check(
    "str6_clean_clock_stream",
    f"""WITH {compared_sql()}, timed AS (SELECT c.*, o.o_orderdate FROM compared c JOIN orders o ON o.o_orderkey = c.o_orderkey),
        run AS (SELECT o_orderkey, epoch_us(o_orderdate) AS moment, max(CASE WHEN divergence_class = 'A' THEN epoch_us(o_orderdate) END)
                  OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS last_a FROM timed)
        SELECT o_orderkey AS comparison_id, round(CAST(moment - greatest({CLOCK_START}, coalesce(last_a, 0)) AS DOUBLE) / 3600000000, 6) AS clean_hours,
               moment - greatest({CLOCK_START}, coalesce(last_a, 0)) >= 72 * 3600000000 AS window_complete FROM run""",
)
def clean_clock_stream(spark, folder) -> DataFrame:
    """The clock over comparisons in eight batches or more, restarted by a class A of any of them."""
    dates = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = compared(spark, folder).join(dates, "o_orderkey")
    rows = carry.with_hits(rows.select(F.lit("orders").alias("stream_id"), F.col("o_orderkey").alias("comparison_id"), "ts", "divergence_class"))
    place = _scratch(spark)
    body = carry.clean_clock(spark, f"{place}/clock", CLOCK_START)
    apply.run_batches(_in_files(rows, ["ts", "comparison_id"], least=8), body, f"{place}/state").awaitTermination()
    return body.results().select("comparison_id", "clean_hours", "window_complete")


@check(
    "str12_late_stream",
    """WITH a AS (SELECT event_id, event_type, CASE WHEN event_id % 41 <> 0 THEN epoch_us(ts) - CASE WHEN event_id % 13 = 0 THEN 200000000000 ELSE 0 END END AS us FROM events),
       m AS (SELECT *, max(us) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a)
       SELECT event_id, coalesce(us < newest - 172800000000, FALSE) AS late FROM m""",
)
def late_stream(spark, folder) -> DataFrame:
    """Rows that arrive two days behind others of their kind are set aside, in whichever batch they come; none is lost."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 13 == 0, F.lit(200_000_000_000)).otherwise(F.lit(0))
    rows = table(spark, folder, "events").select("event_id", "event_type", F.when(F.col("event_id") % 41 != 0, at).alias("us"))
    place = _scratch(spark)
    body = carry.late_split(spark, f"{place}/split", "event_type", ["event_id"], "us", 172_800_000_000)
    apply.run_batches(_in_files(rows, "event_id"), body, f"{place}/state").awaitTermination()
    parts = [body.results(name).select("event_id", F.lit(name == "late").alias("late")) for name in ("out", "late")]
    return parts[0].unionByName(parts[1])


@check("joi1_live_compare", f"WITH {compared_sql()} SELECT o_orderkey, operation, divergence_class FROM compared")
def live_comparison(spark, folder) -> DataFrame:
    """Writes of both sides as two streams, the target's some minutes behind; a last pair of rows ends the waiting."""
    touched, columns = touched_orders(spark, folder), ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

    def arriving(rows: DataFrame, latency: str, delay) -> DataFrame:
        place_in_time = 1_700_000_000 + F.abs("o_orderkey") * 5 + delay
        found = touched.join(rows, "o_orderkey").select("o_orderkey", *columns, F.timestamp_seconds(place_in_time).alias("ts"), "operation", F.col(latency).alias("latency_ms"))
        last = found.agg(F.max(F.unix_seconds("ts")).alias("s")).select(F.timestamp_seconds(F.col("s") + 86_400).alias("ts"))
        return _in_files(found.unionByName(last, allowMissingColumns=True), "ts")

    edge = arriving(edge_orders(spark, folder), "edge_ms", F.lit(0))
    target = arriving(target_orders(spark, folder), "target_ms", F.abs("o_orderkey") % 5 * 60)
    found = _landed(live.live_compare(edge, target, "o_orderkey", columns))
    return found.where("o_orderkey is not null").select("o_orderkey", "operation", "divergence_class")
