"""A change log of orders with repeats, tombstones, broken records and moved keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.plans.registry import table

_T0 = 1_700_000_000_000
MOVED = 10_000_000

# --- the log as SQL --------------------------------------------------------

LOG_SQL = f"""ev AS (
    SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS st, s.step, d.dup,
           CASE WHEN s.step = 0 AND o_orderkey % 19 = 0 THEN 'x' ELSE substr('cud', s.step + 1, 1) END AS raw_op,
           o_orderkey % 4 AS part, o_orderkey * 8 + s.step * 2 + d.dup AS off,
           CASE WHEN o_orderkey % 17 <> 0 THEN 'u:' || o_orderkey || ':' || s.step END AS gtid,
           CASE WHEN o_orderkey % 289 = 0 AND o_orderkey % 34 <> 0 THEN NULL WHEN o_orderkey % 34 = 0 THEN 0
                ELSE {_T0} + o_orderkey * 1000 + s.step END AS ts_ms
    FROM orders, (VALUES (0), (1), (2)) s(step), (VALUES (0), (1)) d(dup)
    WHERE (s.step = 0 OR (s.step = 1 AND o_orderkey % 5 = 0) OR (s.step = 2 AND o_orderkey % 11 = 0))
      AND (d.dup = 0 OR (o_orderkey * 3 + s.step) % 13 = 0)),
log AS (
    SELECT *, CASE WHEN off % 101 = 0 THEN 'tombstone' WHEN off % 103 = 0 THEN 'corrupt' ELSE 'event' END AS status,
           CASE WHEN step = 1 AND k % 35 = 0 THEN k + {MOVED} ELSE k END AS new_k,
           CASE WHEN raw_op = 'x' THEN 'r' ELSE raw_op END AS op,
           coalesce(gtid, CASE WHEN ts_ms IS NULL THEN CAST(off AS VARCHAR) WHEN ts_ms <> 0 THEN CAST(ts_ms AS VARCHAR)
                               ELSE 'no-gtid:cdc.shop.orders:' || part || ':' || off END) AS identity
    FROM ev),
good AS (
    SELECT *, concat_ws('|', identity, 'orders', CASE WHEN step = 2 THEN k ELSE new_k END, op) AS event_id
    FROM log WHERE status = 'event')"""


# --- the same in Spark -----------------------------------------------------


def raw_log(spark, folder) -> DataFrame:
    """Raw records as a broker would hold them: topic, partition, offset, value."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("st")
    )
    k = F.col("k")
    steps = F.array_compact(F.array(F.lit(0), F.when(k % 5 == 0, 1), F.when(k % 11 == 0, 2)))
    flat = rows.withColumn("step", F.explode(steps))
    copies = F.when((k * 3 + F.col("step")) % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    flat = flat.withColumn("dup", F.explode(copies))
    step = F.col("step")
    op = F.when((step == 0) & (k % 19 == 0), "x").otherwise(F.substring(F.lit("cud"), step + 1, F.lit(1)))
    ts = F.when((k % 289 == 0) & (k % 34 != 0), F.lit(None)).when(k % 34 == 0, F.lit(0)).otherwise(
        F.lit(_T0) + k * 1000 + step
    )
    def image(key, customer=None, status=None):
        parts = [F.lit('{"o_orderkey":'), key.cast("string")]
        if customer is not None:
            parts += [F.lit(',"o_custkey":'), customer.cast("string")]
        return F.concat(*parts, F.lit(',"o_orderstatus":"'), status, F.lit('"}'))

    full = image(k, F.col("cust"), F.col("st"))
    old = image(k, status=F.col("st"))
    moved = F.when((step == 1) & (k % 35 == 0), k + MOVED).otherwise(k)
    new = image(moved, status=F.lit("U"))
    before = F.when(step == 0, "null").when(step == 1, old).otherwise(full)
    after = F.when(step == 0, full).when(step == 1, new).otherwise(F.lit("null"))
    gtid = F.when(k % 17 != 0, F.concat(F.lit('"u:'), k.cast("string"), F.lit(":"), step.cast("string"), F.lit('"'))).otherwise(F.lit("null"))
    body = F.concat(
        F.lit('{"op":"'), op, F.lit('","before":'), before, F.lit(',"after":'), after,
        F.lit(',"source":{"gtid":'), gtid, F.lit(',"db":"shop","table":"orders","ts_ms":'),
        F.coalesce(ts.cast("string"), F.lit("null")), F.lit("}}"),
    )
    wrapped = F.when(k % 2 == 0, F.concat(F.lit('{"payload":'), body, F.lit("}"))).otherwise(body)
    offset = k * 8 + step * 2 + F.col("dup")
    value = F.when(offset % 101 == 0, F.lit(None)).when(offset % 103 == 0, "not valid json {").otherwise(wrapped)
    return flat.select(
        F.lit("cdc.shop.orders").alias("topic"), (k % 4).cast("int").alias("partition"),
        offset.alias("offset"), F.explode(F.array(value)).alias("value"),
    )


def stale_target(spark, folder) -> DataFrame:
    """The table before the log: five keys in six, every status open."""
    rows = table(spark, folder, "orders").where(F.col("o_orderkey") % 6 != 0)
    return rows.select("o_orderkey", "o_custkey", F.lit("O").alias("o_orderstatus"))


def fencing_log(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events")
    late = F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    epoch = 1 + F.floor(F.col("event_id") / 2500) - late
    return rows.select(
        F.col("event_id").alias("seq"), epoch.cast("bigint").alias("epoch"),
        F.col("event_type").alias("table_name"), F.lit("u").alias("operation"), F.col("ts").alias("written_at"),
    )


FENCE_SQL = """writes AS (
    SELECT event_id AS seq, 1 + event_id // 2500 - CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS epoch,
           event_type AS table_name FROM events)"""
