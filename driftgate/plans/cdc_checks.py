"""Parsing, deduplication, application and fencing of change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.functions import changes
from driftgate.operators import cdc, compare, fencing
from driftgate.plans.cdc_inputs import FENCE_SQL, LOG_SQL, fencing_log, raw_log, stale_target
from driftgate.plans.inputs import EDGE_SQL, TARGET_SQL, edge_orders, target_orders
from driftgate.plans.registry import check, table
from driftgate.sources import cdc as source
from driftgate.sources import tables

_PK = ["o_orderkey"]


def parsed_log(spark, folder) -> DataFrame:
    return source.parse_cdc(raw_log(spark, folder))


def good_log(spark, folder) -> DataFrame:
    return cdc.with_event_id(source.good_events(parsed_log(spark, folder)), _PK)


@check(
    "prj1_parse_envelope",
    f"""WITH {LOG_SQL}
        SELECT CAST(part AS INTEGER) AS "partition", off AS "offset", status,
               CASE WHEN status = 'event' THEN identity END AS gtid, CASE WHEN status = 'event' THEN op END AS op,
               CASE WHEN status = 'event' AND step = 0 THEN CAST(cust AS VARCHAR) END AS new_cust,
               CASE WHEN status = 'event' AND step > 0 THEN st END AS old_status,
               CASE WHEN status = 'event' THEN coalesce(ts_ms, 0) END AS ts_ms
        FROM log""",
)
def parse_envelope(spark, folder) -> DataFrame:
    is_event = F.col("status") == "event"
    return parsed_log(spark, folder).select(
        "partition", "offset", "status", F.when(is_event, F.col("gtid")).alias("gtid"),
        F.when(is_event, F.col("op")).alias("op"),
        F.try_element_at("after", F.lit("o_custkey")).alias("new_cust"),
        F.try_element_at("before", F.lit("o_orderstatus")).alias("old_status"),
        F.when(is_event, F.col("ts_ms")).alias("ts_ms"),
    )


@check(
    "prj2_decode_op",
    f"WITH {LOG_SQL} SELECT op, raw_op = 'x' AS op_unknown, count(*) AS n_rows FROM good GROUP BY 1, 2",
)
def decode_op(spark, folder) -> DataFrame:
    return source.good_events(parsed_log(spark, folder)).groupBy("op", "op_unknown").agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "prj3_event_identity",
    f"""WITH {LOG_SQL} SELECT CASE WHEN starts_with(identity, 'u:') THEN 'transaction' WHEN starts_with(identity, 'no-gtid') THEN 'position'
               WHEN ts_ms IS NULL THEN 'offset' ELSE 'time' END AS identity_kind, count(*) AS n_rows, count(DISTINCT identity) AS ids
        FROM good GROUP BY 1""",
)
def event_identity(spark, folder) -> DataFrame:
    rows = source.good_events(parsed_log(spark, folder))
    kind = (
        F.when(F.col("gtid").startswith("u:"), "transaction").when(F.col("gtid").startswith("no-gtid"), "position")
        .when(F.col("gtid") == F.col("offset").cast("string"), "offset").otherwise("time")
    )
    return rows.groupBy(kind.alias("identity_kind")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("gtid").alias("ids")
    )


@check(
    "prj22_lag_seconds",
    f"""WITH {LOG_SQL} SELECT off AS "offset", CASE WHEN coalesce(ts_ms, 0) = 0 THEN 0.0::DOUBLE
               ELSE round(greatest(0.0::DOUBLE, (1700005000000 - ts_ms) / 1000.0::DOUBLE), 2) END AS lag_seconds FROM good""",
)
def lag_seconds(spark, folder) -> DataFrame:
    rows = source.good_events(parsed_log(spark, folder))
    return rows.select("offset", changes.lag_seconds(F.col("ts_ms"), F.lit(1_700_005_000_000)).alias("lag_seconds"))


@check(
    "prj25_infer_pk",
    f"""WITH {LOG_SQL} SELECT op, CASE WHEN step = 1 THEN 'order_id,id' ELSE 'order_id,id' END AS pk_columns, count(*) AS n_rows
        FROM good WHERE step = 1 GROUP BY 1, 2
        UNION ALL SELECT op, 'id', count(*) FROM good WHERE step = 1 GROUP BY 1""",
)
def infer_pk(spark, folder) -> DataFrame:
    """Two image shapes: a changed id falls back to the suffix rule, an unchanged one is taken."""
    rows = source.good_events(parsed_log(spark, folder)).where("op = 'u'")
    key = F.try_element_at("before", F.lit("o_orderkey"))
    before = F.create_map(F.lit("order_id"), key, F.lit("id"), key, F.lit("status"), F.lit("a"))
    changed = F.create_map(F.lit("order_id"), key, F.lit("id"), F.concat(key, F.lit("0")), F.lit("status"), F.lit("b"))
    same = F.create_map(F.lit("order_id"), key, F.lit("id"), key, F.lit("status"), F.lit("b"))
    both = rows.select("op", F.explode(F.array(changed, same)).alias("after"), before.alias("before"))
    names = F.array_join(changes.infer_pk(F.col("before"), F.col("after")), ",")
    return both.groupBy("op", names.alias("pk_columns")).agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "prj25_infer_pk_of_log",
    f"""WITH {LOG_SQL} SELECT op, CASE step WHEN 1 THEN CASE WHEN new_k = k THEN 'id' ELSE 'id,status_id' END WHEN 2 THEN 'id,cust_id,status_id' END AS pk_columns,
            count(*) AS n_rows FROM good GROUP BY 1, 2""",
)
def infer_pk_of_log(spark, folder) -> DataFrame:
    """Keys read from the log's own images, all operations: an unchanged id, a moved one, a deletion, and none for an insertion."""
    names = {"o_orderkey": "id", "o_custkey": "cust_id", "o_orderstatus": "status_id"}
    rename = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = source.good_events(parsed_log(spark, folder))
    before, after = (F.transform_keys(side, lambda k, v: rename[k]) for side in ("before", "after"))
    keys = F.array_join(changes.infer_pk(F.col("b"), F.col("a")), ",")
    return rows.select("op", before.alias("b"), after.alias("a")).groupBy("op", keys.alias("pk_columns")).agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "prj28_topic_names",
    """SELECT 'cdc.shop.' || event_type AS topic, 'cdc.dlq' AS dlq, 'cdc.schema-history' AS history,
              'shop' AS database, event_type AS table_name, count(*) AS n_rows FROM events GROUP BY event_type""",
)
def topic_names(spark, folder) -> DataFrame:
    prefix = F.lit("cdc")
    named = table(spark, folder, "events").select(
        changes.topic_name(prefix, F.lit("shop"), F.col("event_type")).alias("topic"),
        changes.dlq_topic_name(prefix).alias("dlq"), changes.history_topic_name(prefix).alias("history"),
    )
    parts = changes.topic_parts(F.col("topic"))
    return named.groupBy(
        "topic", "dlq", "history", parts["database"].alias("database"), parts["table"].alias("table_name")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "snk2_dead_letters",
    f"""WITH {LOG_SQL} SELECT 'cdc.shop.orders' AS original_topic, CAST(part AS INTEGER) AS original_partition, off AS original_offset,
               'not valid json {{' AS original_value, 'unparsable event' AS failure_reason, '2024-01-31' AS failed_on
        FROM log WHERE status = 'corrupt'""",
)
def dead_letters(spark, folder) -> DataFrame:
    moment = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    _, bad = source.split_dlq(raw_log(spark, folder), moment)
    return bad.withColumn("failed_on", F.date_format("failed_at", "yyyy-MM-dd")).drop("failed_at")


@check(
    "win2_first_delivery",
    f"""WITH {LOG_SQL} SELECT event_id, CAST(part AS INTEGER) AS "partition", off AS "offset", op FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part, off) AS r FROM good) WHERE r = 1""",
)
def first_delivery(spark, folder) -> DataFrame:
    return cdc.first_deliveries(good_log(spark, folder)).select("event_id", "partition", "offset", "op")


@check(
    "win2_first_delivery_by_transaction",
    f"""WITH {LOG_SQL} SELECT op, count(*) AS n_rows FROM (
            SELECT *, row_number() OVER (PARTITION BY identity ORDER BY part, off) AS r FROM good) WHERE r = 1 GROUP BY op""",
)
def first_delivery_by_transaction(spark, folder) -> DataFrame:
    """One row per transaction id, the coarser identity."""
    rows = cdc.with_event_id(source.good_events(parsed_log(spark, folder)), id_mode="gtid")
    return cdc.first_deliveries(rows).groupBy("op").agg(F.count(F.lit(1)).alias("n_rows"))


_LEDGER_SQL = "ledger AS (SELECT DISTINCT event_id FROM good WHERE k % 3 = 0)"


def _ledger(spark, folder) -> DataFrame:
    rows = good_log(spark, folder)
    key = F.coalesce(F.try_element_at("before", F.lit("o_orderkey")), F.try_element_at("after", F.lit("o_orderkey")))
    return rows.where(key.cast("bigint") % 3 == 0).select("event_id").distinct()


@check(
    "joi4_ledger_dedup",
    f"""WITH {LOG_SQL}, {_LEDGER_SQL} SELECT op, count(DISTINCT event_id) AS n_rows FROM good
        WHERE event_id NOT IN (SELECT event_id FROM ledger) GROUP BY op""",
)
def ledger_dedup(spark, folder) -> DataFrame:
    fresh = cdc.dedup_batch(good_log(spark, folder), _ledger(spark, folder))
    return fresh.groupBy("op").agg(F.count(F.lit(1)).alias("n_rows"))


_ORD = "CAST(coalesce(ts_ms, 0) AS HUGEINT) * 1000000000 + off * 2"
STEPS_SQL = f"""steps AS (
    SELECT new_k AS pk, {_ORD} + 1 AS ord, FALSE AS removes, CASE WHEN step = 0 THEN cust END AS cust,
           CASE WHEN step = 0 THEN st ELSE 'U' END AS st, step = 0 AS has_cust FROM good WHERE step < 2
    UNION ALL SELECT k, {_ORD}, TRUE, NULL, NULL, FALSE FROM good WHERE step = 2 OR (step = 1 AND new_k <> k)),
deleted AS (SELECT pk, max(ord) FILTER (removes) AS del_at FROM steps GROUP BY pk),
net AS (
    SELECT s.pk, max(d.del_at) AS del_at, max(s.ord) FILTER (NOT s.removes) AS put_at,
           arg_max(s.cust, s.ord) FILTER (s.has_cust AND s.ord > coalesce(d.del_at, -1)) AS cust,
           arg_max(s.st, s.ord) FILTER (NOT s.removes AND s.ord > coalesce(d.del_at, -1)) AS st
    FROM steps s JOIN deleted d ON s.pk = d.pk GROUP BY s.pk),
held AS (SELECT o_orderkey, o_custkey, 'O' AS o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0),
applied AS (
    SELECT coalesce(h.o_orderkey, n.pk) AS o_orderkey,
           coalesce(n.cust, CASE WHEN n.del_at IS NULL THEN h.o_custkey END) AS o_custkey,
           coalesce(n.st, CASE WHEN n.del_at IS NULL THEN h.o_orderstatus END) AS o_orderstatus
    FROM held h FULL OUTER JOIN net n ON h.o_orderkey = n.pk
    WHERE n.pk IS NULL OR (n.put_at IS NOT NULL AND n.put_at > coalesce(n.del_at, -1)))"""


@check("joi5_apply_changes", f"WITH {LOG_SQL}, {STEPS_SQL} SELECT * FROM applied")
def apply_changes(spark, folder) -> DataFrame:
    events = cdc.first_deliveries(good_log(spark, folder))
    return cdc.apply_changes(stale_target(spark, folder), events, _PK)


@check(
    "win3_net_effect",
    f"""WITH {LOG_SQL}, {STEPS_SQL} SELECT pk, put_at IS NOT NULL AND put_at > coalesce(del_at, -1) AS alive,
               del_at IS NOT NULL AS was_deleted, st AS o_orderstatus FROM net""",
)
def net_effect(spark, folder) -> DataFrame:
    net = cdc.net_changes(cdc.first_deliveries(good_log(spark, folder)), _PK, ["o_custkey", "o_orderstatus"])
    return net.select(
        F.col("_pk_o_orderkey").cast("bigint").alias("pk"), F.col("_alive").alias("alive"),
        F.col("_reset").alias("was_deleted"), F.col("_set_o_orderstatus.v").alias("o_orderstatus"),
    )


@check(
    "snk1_upsert",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, batch AS (SELECT * FROM edge WHERE o_orderkey % 10 = 0)
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch)
        UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM batch""",
)
def upsert(spark, folder) -> DataFrame:
    batch = edge_orders(spark, folder).where(F.col("o_orderkey") % 10 == 0)
    return tables.upsert_rows(target_orders(spark, folder), batch, _PK).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@check(
    "snk4_ledger_purge",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS applied_day, count(*) AS n_rows FROM events
       WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY 1""",
)
def ledger_purge(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("ts").alias("applied_at"))
    kept = tables_purge(rows)
    return kept.groupBy(F.date_format("applied_at", "yyyy-MM-dd").alias("applied_day")).agg(F.count(F.lit(1)).alias("n_rows"))


def tables_purge(rows: DataFrame) -> DataFrame:
    return cdc.purge_ledger(rows, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), days=10)


@check(
    "snk6_sink_counters",
    f"""WITH {LOG_SQL}, {_LEDGER_SQL},
        ids AS (SELECT event_id, count(*) AS n, event_id IN (SELECT event_id FROM ledger) AS seen FROM good GROUP BY event_id),
        lastone AS (SELECT identity, coalesce(ts_ms, 0) AS t FROM good WHERE event_id NOT IN (SELECT event_id FROM ledger)
                    ORDER BY coalesce(ts_ms, 0) DESC, off DESC LIMIT 1)
        SELECT (SELECT count(*) FROM ids WHERE NOT seen) AS events_processed,
               (SELECT CAST(sum(CASE WHEN seen THEN n ELSE n - 1 END) AS BIGINT) FROM ids) AS events_deduplicated,
               (SELECT count(*) FROM log WHERE status = 'corrupt') AS events_dlq,
               (SELECT count(*) FROM log WHERE status = 'tombstone') AS tombstones,
               (SELECT identity FROM lastone) AS last_gtid, (SELECT t FROM lastone) AS last_event_ts_ms""",
)
def sink_counters(spark, folder) -> DataFrame:
    return cdc.sink_counters(parsed_log(spark, folder), _PK, ledger=_ledger(spark, folder))


@check(
    "agg15_outcomes",
    f"""WITH {LOG_SQL}, {_LEDGER_SQL}
        SELECT CASE WHEN r = 1 AND event_id NOT IN (SELECT event_id FROM ledger) THEN 'applied' ELSE 'deduplicated' END AS outcome,
               count(*) AS n_rows, max(off) AS last_offset
        FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part, off) AS r FROM good) GROUP BY 1""",
)
def outcomes(spark, folder) -> DataFrame:
    tagged = cdc.apply_outcomes(good_log(spark, folder), _ledger(spark, folder))
    return tagged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"), F.max("offset").alias("last_offset"))


@check(
    "agg30_idempotency",
    f"""WITH {LOG_SQL}, {STEPS_SQL} SELECT 1::BIGINT AS most_rows_per_key, (SELECT count(*) FROM applied) AS "keys",
               1::BIGINT AS most_entries_per_id, (SELECT count(DISTINCT event_id) FROM good) AS ids, TRUE AS passed""",
)
def idempotency(spark, folder) -> DataFrame:
    return cdc.idempotency_audit(stale_target(spark, folder), good_log(spark, folder), _PK)


@check(
    "agg16_consumer_lag",
    f"""WITH {LOG_SQL}, parts AS (SELECT part, max(off) + 1 AS end_offset, max(off) + 1 - count(*) % 100 AS committed FROM log GROUP BY part)
        SELECT 'cdc.shop.orders' AS topic, CAST(sum(end_offset - committed) AS BIGINT) AS lag_records FROM parts""",
)
def consumer_lag(spark, folder) -> DataFrame:
    end = F.max("offset") + 1
    offsets = raw_log(spark, folder).groupBy("topic", "partition").agg(
        end.alias("end_offset"), (end - F.count(F.lit(1)) % 100).alias("committed_offset")
    )
    return source.consumer_lag(offsets)


@check(
    "str11_retention_guard",
    f"""WITH {LOG_SQL} SELECT 'cdc.shop.orders' AS topic,
               round(greatest(0.0::DOUBLE, (1700400000000 - max(coalesce(ts_ms, 0))) / 1000.0::DOUBLE), 2) AS lag_seconds,
               (1700400000000 - max(coalesce(ts_ms, 0))) / 1000.0::DOUBLE >= 4 * 86400 AS retention_at_risk FROM good""",
)
def retention_guard(spark, folder) -> DataFrame:
    return source.retention_guard(source.good_events(parsed_log(spark, folder)), 1_700_400_000_000)


_FENCED_SQL = f"""{FENCE_SQL}, fenced AS (
    SELECT *, greatest(0, coalesce(max(epoch) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS max_seen FROM writes)"""


@check(
    "win1_fence",
    f"WITH {_FENCED_SQL} SELECT seq, CAST(epoch AS BIGINT) AS epoch, CAST(max_seen AS BIGINT) AS max_seen, epoch >= max_seen AS accepted FROM fenced",
)
def fence(spark, folder) -> DataFrame:
    return fencing.fence(fencing_log(spark, folder)).select("seq", "epoch", "max_seen", "accepted")


@check(
    "win1_fence_by_domain",
    f"""WITH {FENCE_SQL}, fenced AS (SELECT *, coalesce(max(epoch) OVER (PARTITION BY table_name ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS max_seen FROM writes)
        SELECT table_name, epoch >= max_seen AS accepted, count(*) AS n_rows FROM fenced GROUP BY 1, 2""",
)
def fence_by_domain(spark, folder) -> DataFrame:
    fenced = fencing.fence(fencing_log(spark, folder), keys=["table_name"])
    return fenced.groupBy("table_name", "accepted").agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "snk5_fencing_audit",
    f"""WITH {_FENCED_SQL} SELECT CASE WHEN epoch >= max_seen THEN 'audit' ELSE 'violations' END AS sink,
               CAST(epoch AS BIGINT) AS epoch, count(*) AS n_rows FROM fenced GROUP BY 1, 2""",
)
def fencing_audit(spark, folder) -> DataFrame:
    accepted, violations = fencing.audit_rows(fencing.fence(fencing_log(spark, folder)))
    both = accepted.select(F.lit("audit").alias("sink"), "epoch").unionByName(
        violations.select(F.lit("violations").alias("sink"), "epoch")
    )
    return both.groupBy("sink", "epoch").agg(F.count(F.lit(1)).alias("n_rows"))


@check(
    "win13_lost_leases",
    """WITH b AS (SELECT event_id, user_id, ts, value < 50 AS ok FROM events),
       g AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM b),
       f AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY event_id) AS r FROM g WHERE NOT ok)
       SELECT event_id, user_id FROM f WHERE r = 3""",
)
def lost_leases(spark, folder) -> DataFrame:
    beats = table(spark, folder, "events").select("event_id", "user_id", (F.col("value") < 50).alias("ok"))
    return fencing.lost_leases(beats, ["event_id"], "ok", ["user_id"]).select("event_id", "user_id")


@check(
    "joi12_missing_topics",
    """WITH expected AS (SELECT DISTINCT 'cdc.shop.' || user_id AS topic FROM events),
            landed AS (SELECT DISTINCT 'cdc.shop.' || user_id AS topic FROM events WHERE event_type = 'purchase')
       SELECT topic FROM expected WHERE topic NOT IN (SELECT topic FROM landed)""",
)
def missing_topics(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events")
    topic = changes.topic_name(F.lit("cdc"), F.lit("shop"), F.col("user_id").cast("string")).alias("topic")
    expected = rows.select(topic).distinct()
    landed = rows.where("event_type = 'purchase'").select(topic)
    return compare.missing_names(expected, landed, "topic")
