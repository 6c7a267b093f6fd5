"""Traffic profile from a query log or from exported statement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.functions.changes import statement_preview, statement_verb
from driftgate.functions.risk_rules import latency_proxy
from driftgate.operators.selection import exact_percentiles

WRITE_VERBS = ("INSERT", "UPDATE", "DELETE")


def statement_rates(statements: DataFrame) -> DataFrame:
    """Reads, writes and all calls per second of statement time.

    ``statements`` has digest_text, calls and wait_seconds.
    """
    verb = statement_verb(F.col("digest_text"))
    busy = F.sum("wait_seconds")

    def rate(which: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(F.sum(F.when(which, F.col("calls")).otherwise(0)), busy), F.lit(0.0)), 6)

    return statements.agg(
        rate(verb == "SELECT").alias("select_qps"), rate(verb.isin(*WRITE_VERBS)).alias("write_qps"),
        rate(F.lit(True)).alias("total_qps"),
    )


def table_traffic(log: DataFrame) -> DataFrame:
    """Calls and total time per table and verb, as one row per table.

    ``log`` has table_name, verb and latency_ms: one row per statement, or one
    per group with calls.
    """
    calls = F.col("calls") if "calls" in log.columns else F.lit(1)
    names = {"select": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE"}
    figures = []
    for short, verb in names.items():
        mine = F.col("verb") == verb
        figures.append(F.sum(F.when(mine, calls).otherwise(0)).cast("bigint").alias(f"{short}_count"))
        figures.append(F.coalesce(F.sum(F.when(mine, F.col("latency_ms").cast("decimal(18,3)"))), F.lit(0)).cast("double").alias(f"{short}_total_ms"))
    return log.groupBy("table_name").agg(*figures)


def with_latency_proxies(traffic: DataFrame) -> DataFrame:
    """Add latency figures estimated from means, for reads and inserts."""
    return traffic.select(
        "*",
        latency_proxy(F.col("select_total_ms"), F.col("select_count")).alias("select_latency"),
        latency_proxy(F.col("insert_total_ms"), F.col("insert_count")).alias("insert_latency"),
    )


def true_latencies(log: DataFrame, exact: bool = True) -> DataFrame:
    """Measured p50, p95, p99 and maximum per table and verb, where single latencies exist.

    Exact figures come from ranges of the order, so a table with most of the calls is no single buffer; ``exact=False``
    takes a bounded sketch instead, in one pass.
    """
    points = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    keys = ["table_name", "verb"]
    figures = [F.max("latency_ms").alias("max_ms"), F.count(F.lit(1)).alias("calls")]
    if exact:
        counted = log.groupBy(F.struct(*keys).alias("_k")).agg(*figures)
        found = exact_percentiles(log, keys, "latency_ms", points).select(F.struct(*keys).alias("_k"), *points)
        return counted.join(found, "_k", "left").select("_k.*", *points, "max_ms", "calls")
    sketch = F.percentile_approx("latency_ms", list(points.values()), 10_000)
    grouped = log.groupBy(*keys).agg(sketch.alias("_p"), *figures)
    return grouped.select(*keys, *[F.col("_p")[i].alias(name) for i, name in enumerate(points)], "max_ms", "calls")


def _writes() -> Column:
    return F.col("insert_count") + F.col("update_count") + F.col("delete_count")


def write_amplification(traffic: DataFrame) -> DataFrame:
    """All writes over inserts, at most 20; 1 without writes."""
    writes, inserts = F.sum(_writes()), F.sum("insert_count")
    ratio = F.round(F.least(writes / F.greatest(inserts, F.lit(1)), F.lit(20.0)), 2)
    return traffic.agg(F.when(writes > 0, ratio).otherwise(F.lit(1.0)).alias("write_amplification"))


def batch_write_ratio(traffic: DataFrame) -> DataFrame:
    """Share of writes that are inserts into tables inserting over ten times what they change."""
    changed = F.col("update_count") + F.col("delete_count")
    is_batch = (changed > 0) & (F.col("insert_count") / F.greatest(changed, F.lit(0.001)) > 10)
    bulk = F.sum(F.when(is_batch, F.col("insert_count")).otherwise(0))
    return traffic.agg(F.round(bulk / F.greatest(F.sum(_writes()), F.lit(0.001)), 4).alias("batch_write_ratio"))


def busiest_tables(traffic: DataFrame, n: int | None = None) -> DataFrame:
    """Tables by number of writes; the first ``n`` if given."""
    ordered = traffic.select("table_name", _writes().alias("writes")).orderBy(F.desc("writes"), "table_name")
    return ordered if n is None else ordered.limit(n)


def load_pattern(log: DataFrame, ts: str, by: str = "hour") -> DataFrame:
    """Load by hour of day or weekday (0 is Monday), relative to the busiest; flat 1.0 without data."""
    slots = {"hour": 24, "weekday": 7}[by]
    slot = F.hour(ts) if by == "hour" else F.weekday(ts)
    counted = log.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("calls"))
    everything = log.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    joined = everything.join(counted, "slot", "left")
    whole = Window.partitionBy()  # at most 24 rows
    peak = F.max("calls").over(whole)
    load = F.when(peak.isNull(), F.lit(1.0)).otherwise(F.round(F.col("calls").cast("double") / peak, 3))
    return joined.select("slot", load.alias("load"), peak.isNull().alias("_flat"), "calls").where(
        "_flat or calls is not null"
    ).select("slot", "load")


def connection_stats(sessions: DataFrame, max_connections: int) -> DataFrame:
    """Active and idle connections and the share of the limit they take.

    ``sessions`` has the command of every open connection; Sleep is idle.
    """
    active, idle = F.count_if(F.col("command") != "Sleep"), F.count_if(F.col("command") == "Sleep")
    return sessions.agg(
        active.alias("active"), idle.alias("idle"),
        F.round((active + idle) / F.lit(float(max_connections)) * 100, 2).alias("utilisation_pct"),
    )


def write_attempts(log: DataFrame, cutover: Column, n: int | None = None, ts: str = "ts") -> DataFrame:
    """Write statements after the cutover, newest first; the latest ``n`` if given."""
    after = log.where(statement_verb(F.col("statement")).isin(*WRITE_VERBS) & (F.col(ts) > cutover))
    shown = after.select(ts, "client", statement_preview(F.col("statement")).alias("preview"))
    ordered = shown.orderBy(F.desc(ts), "client")
    return ordered if n is None else ordered.limit(n)
