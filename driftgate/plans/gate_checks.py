"""Snapshot progress, metric timelines, gates and reports on figures read from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.operators import cdc, gates, report, snapshot, timeline
from driftgate.plans.cdc_checks import good_log
from driftgate.plans.cdc_inputs import stale_target
from driftgate.plans.discovery_checks import LOG_SQL as QUERY_SQL
from driftgate.plans.discovery_checks import query_log, reference_scan
from driftgate.plans.inputs import EDGE_SQL, TARGET_SQL, edge_orders, target_orders
from driftgate.plans.registry import check, table
from driftgate.plans.risk_checks import SERIES_SQL, hourly

_SLOT = 600_000_000

# --- snapshot progress -----------------------------------------------------

_TRIES_SQL = """tries AS (
    SELECT 't' || (l_suppkey % 10) AS table_name, l_partkey AS chunk_index, CAST(l_linenumber - 1 AS BIGINT) AS attempt,
           bool_or(l_returnflag = 'A') AS ok, CAST(sum(l_quantity) AS BIGINT) AS "rows", CAST(sum(round(l_extendedprice)) AS BIGINT) AS bytes,
           max(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2, 3),
final AS (
    SELECT table_name, chunk_index, min(attempt) FILTER (ok) AS won, max(attempt) AS last_try,
           arg_min("rows", attempt) FILTER (ok) AS r, arg_min(bytes, attempt) FILTER (ok) AS b
    FROM tries WHERE attempt <= 3 GROUP BY 1, 2)"""


def attempts(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.groupBy(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 10).cast("string")).alias("table_name"),
        F.col("l_partkey").alias("chunk_index"), (F.col("l_linenumber") - 1).cast("bigint").alias("attempt"),
    ).agg(
        F.bool_or(F.col("l_returnflag") == "A").alias("ok"), F.sum("l_quantity").cast("bigint").alias("rows"),
        F.sum(F.round("l_extendedprice")).cast("bigint").alias("bytes"), F.max("l_shipdate").alias("ts"),
    )


@check(
    "str13_chunk_outcomes",
    f"""WITH {_TRIES_SQL} SELECT table_name, chunk_index, CASE WHEN won IS NOT NULL THEN 'completed' ELSE 'quarantined' END AS status,
               coalesce(won, last_try) AS retries, coalesce(r, 0) AS "rows", coalesce(b, 0) AS bytes FROM final""",
)
def chunk_outcomes(spark, folder) -> DataFrame:
    return snapshot.chunk_outcomes(attempts(spark, folder)).drop("ts")


@check(
    "agg14_snapshot_progress",
    f"""WITH {_TRIES_SQL}, t AS (SELECT table_name, count(*) AS chunks, count(won) AS done, coalesce(sum(r), 0) AS r, coalesce(sum(b), 0) AS b FROM final GROUP BY 1)
        SELECT count(*) AS total_tables, count(*) FILTER (done = chunks) AS completed_tables, CAST(sum(chunks) AS BIGINT) AS total_chunks,
               CAST(sum(done) AS BIGINT) AS completed_chunks, CAST(sum(chunks - done) AS BIGINT) AS failed_chunks,
               coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (done < chunks), '') AS quarantined_tables,
               CAST(sum(r) AS BIGINT) AS rows_transferred, CAST(sum(b) AS BIGINT) AS bytes_transferred,
               round(CAST(sum(b) AS DOUBLE) / 3600 / 1e6, 6) AS throughput_mbps,
               round(greatest(10000000000 - sum(b), 0) / (CAST(sum(b) AS DOUBLE) / 3600), 3) AS eta_seconds FROM t""",
)
def snapshot_progress(spark, folder) -> DataFrame:
    return snapshot.snapshot_progress(snapshot.chunk_outcomes(attempts(spark, folder)), 3600, 10_000_000_000)


_PROGRESS_SQL = """slots AS (SELECT user_id % 4 AS run, (epoch_us(ts) // 1800000000) * 1800000000 AS us, CAST(sum(round(value * 10000000)) AS BIGINT) AS b FROM events GROUP BY 1, 2),
    prog AS (SELECT run, us, CAST(sum(b) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done_bytes FROM slots)"""


@check(
    "win4_dead_man",
    f"""WITH {_PROGRESS_SQL}, w AS (SELECT *, done_bytes - first(done_bytes) OVER f AS gained_bytes, count(*) OVER f AS checkpoints FROM prog
            WINDOW f AS (PARTITION BY run ORDER BY us RANGE BETWEEN {4 * 3_600_000_000} PRECEDING AND CURRENT ROW))
        SELECT run, us, done_bytes, CAST(gained_bytes AS BIGINT) AS gained_bytes, checkpoints, checkpoints >= 2 AND gained_bytes < 4000000000 AS alert FROM w""",
)
def dead_man(spark, folder) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = (at - F.pmod(at, F.lit(1_800_000_000))).alias("us")
    slots = table(spark, folder, "events").groupBy((F.col("user_id") % 4).alias("run"), slot).agg(
        F.sum(F.round(F.col("value") * 10_000_000)).cast("bigint").alias("b")
    )
    so_far = F.sum("b").over(Window.partitionBy("run").orderBy("us").rowsBetween(Window.unboundedPreceding, 0))
    series = slots.select("run", "us", so_far.alias("done_bytes"), F.timestamp_micros("us").alias("ts"))
    return snapshot.dead_man(series, "ts", "done_bytes", "run").drop("ts")


# --- timelines -------------------------------------------------------------

@check(
    "win6_throttle",
    f"""WITH {SERIES_SQL}, s AS (SELECT run_id, us, mx, CASE WHEN mx > 120 THEN 3 WHEN mx < 60 THEN 5 END AS sig FROM series),
        m AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY us ROWS UNBOUNDED PRECEDING), 5) AS now_m FROM s),
        p AS (SELECT *, coalesce(lag(now_m) OVER (PARTITION BY run_id ORDER BY us), 5) AS before_m FROM m)
        SELECT run_id, us, now_m AS multiplier, now_m = 3 AND before_m = 5 AS throttle_event FROM p""",
)
def throttle(spark, folder) -> DataFrame:
    metrics = hourly(spark, folder).withColumn("lag_seconds", F.col("mx"))
    return timeline.throttle(metrics, ["us"], keys=["run_id"]).select("run_id", "us", "multiplier", "throttle_event")


@check(
    "win9_sustained",
    f"""WITH {SERIES_SQL}, w AS (SELECT *, max(mx) OVER f AS worst, min(us) OVER f AS since FROM series
            WINDOW f AS (PARTITION BY run_id ORDER BY us RANGE BETWEEN {4 * 3_600_000_000} PRECEDING AND CURRENT ROW))
        SELECT run_id, us, worst <= 100 AND us - since >= {4 * 3_600_000_000} AS sustained FROM w""",
)
def sustained(spark, folder) -> DataFrame:
    return timeline.sustained(hourly(spark, folder), "ts", "mx", "<=", 100.0, V.PREFLIGHT_SUSTAINED_HOURS, ["run_id"]).select(
        "run_id", "us", "sustained"
    )


@check(
    "win10_worst_window",
    """WITH w AS (SELECT event_type, (epoch_us(ts) // 600000000) * 600000000 AS us, max(value) AS worst FROM events GROUP BY 1, 2)
       SELECT event_type, us, worst FROM w""",
)
def worst_window(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = timeline.worst_window(rows, "ts", "value", keys=["event_type"])
    return found.select("event_type", F.unix_micros("window.start").alias("us"), "worst")


_HEALTH_SQL = """metrics AS (SELECT user_id % 8 AS series, ts, value AS lag_seconds, CASE WHEN event_id % 10 = 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS divergence_pct FROM events)"""


def _health(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        (F.col("user_id") % 8).alias("series"), "ts", F.col("value").alias("lag_seconds"),
        F.when(F.col("event_id") % 10 == 0, 0.01).otherwise(0.0).alias("divergence_pct"),
    )


@check(
    "win16_time_to_recovery",
    f"""WITH {_HEALTH_SQL}, faults AS (SELECT event_id AS fault_id, user_id % 8 AS series, ts AS cleared_at FROM events WHERE event_type = 'error' AND value > 100),
        r AS (SELECT f.fault_id, min(epoch_us(m.ts) - epoch_us(f.cleared_at)) AS us FROM faults f LEFT JOIN metrics m ON m.series = f.series
              AND m.ts >= f.cleared_at AND m.ts <= f.cleared_at + INTERVAL 6 HOUR AND m.lag_seconds < 30 AND m.divergence_pct <= 0.001 GROUP BY 1)
        SELECT fault_id, round(us / 1e6, 3) AS recovery_seconds, us IS NOT NULL AS recovered FROM r""",
)
def time_to_recovery(spark, folder) -> DataFrame:
    faults = table(spark, folder, "events").where("event_type = 'error' and value > 100").select(
        F.col("event_id").alias("fault_id"), (F.col("user_id") % 8).alias("series"), F.col("ts").alias("cleared_at")
    )
    found = timeline.time_to_recovery(faults, _health(spark, folder), "fault_id", "cleared_at", "ts", "series", 6 * 3600)
    return found.select("fault_id", "recovery_seconds", "recovered")


@check(
    "win17_lag_shift",
    f"""WITH {_HEALTH_SQL}, ch AS (SELECT event_id AS change_id, user_id % 8 AS series, ts AS changed_at FROM events WHERE event_type = 'signup'),
        r AS (SELECT c.change_id, arg_max(m.lag_seconds, m.ts) FILTER (m.ts <= c.changed_at) AS lag_before,
                     arg_max(m.lag_seconds, m.ts) FILTER (m.ts > c.changed_at) AS lag_after
              FROM ch c LEFT JOIN metrics m ON m.series = c.series AND m.ts >= c.changed_at - INTERVAL 1 HOUR AND m.ts <= c.changed_at + INTERVAL 2 HOUR GROUP BY 1)
        SELECT change_id, lag_before, lag_after, round(abs(lag_after - lag_before), 6) AS lag_delta, coalesce(abs(lag_after - lag_before) < 30, FALSE) AS stable FROM r""",
)
def lag_shift(spark, folder) -> DataFrame:
    changes = table(spark, folder, "events").where("event_type = 'signup'").select(
        F.col("event_id").alias("change_id"), (F.col("user_id") % 8).alias("series"), F.col("ts").alias("changed_at")
    )
    found = timeline.lag_shift(changes, _health(spark, folder), "change_id", "changed_at", "ts", "series", 3600, 7200)
    return found.select("change_id", "lag_before", "lag_after", "lag_delta", "stable")


# --- replay benchmarks and score, one run per user -------------------------

_PEAKS_SQL = """peaks AS (
    SELECT user_id AS run_id, max(value) AS peak_consumer_lag_seconds, max(CASE WHEN event_id % 10 = 0 THEN 0.002::DOUBLE ELSE 0.0::DOUBLE END) AS max_merkle_divergence_pct,
           arg_max(value * 3, ts) AS p99_insert_latency_ms, arg_max(value * 4, ts) AS p99_select_latency_ms,
           arg_max(100 - (event_id % 5) / 20.0::DOUBLE, ts) AS lease_renewal_success_rate_pct,
           abs((arg_max(value * 25, ts) - 1000) / 1000 * 100) AS risk_stability_pct
    FROM events GROUP BY user_id)"""
_PEAK_NAMES = [
    "peak_consumer_lag_seconds", "max_merkle_divergence_pct", "p99_insert_latency_ms", "p99_select_latency_ms",
    "lease_renewal_success_rate_pct", "risk_stability_pct",
]
_BENCH_SQL = f"""{_PEAKS_SQL}, bench AS (
    SELECT run_id, check_id, metric, actual, "limit", CASE WHEN check_id = 'B-006' THEN actual >= "limit" ELSE actual <= "limit" END AS passed
    FROM (""" + " UNION ALL ".join(
    f"SELECT run_id, '{check}' AS check_id, '{metric}' AS metric, {metric} AS actual, {limit}::DOUBLE AS \"limit\" FROM peaks"
    for check, metric, _, limit in V.REPLAY_BENCHMARKS
) + "))"


def peaks(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events")
    value, number = F.col("value"), F.col("event_id")
    samples = rows.select(
        F.col("user_id").alias("run_id"), "ts", value.alias("lag_seconds"),
        F.when(number % 10 == 0, 0.002).otherwise(0.0).alias("divergence_pct"),
        (value * 3).alias("p99_insert_latency_ms"), (value * 4).alias("p99_select_latency_ms"),
        (F.lit(100) - (number % 5) / F.lit(20.0)).alias("lease_renewal_success_rate_pct"), (value * 25).alias("risk_p95_usd"),
    )
    return timeline.peak_snapshot(samples, "ts", 1000.0, ["run_id"])


def benchmarks(spark, folder) -> DataFrame:
    return gates.evaluate_gate(timeline.as_long(peaks(spark, folder), "run_id", _PEAK_NAMES), V.REPLAY_BENCHMARKS)


@check(
    "agg19_peak_snapshot",
    f"WITH {_PEAKS_SQL} SELECT run_id, {', '.join(f'round({n}, 6) AS {n}' for n in _PEAK_NAMES)} FROM peaks",
)
def peak_snapshot(spark, folder) -> DataFrame:
    return peaks(spark, folder).select("run_id", *[F.round(n, 6).alias(n) for n in _PEAK_NAMES])


@check("gat1_replay_benchmarks", f"WITH {_BENCH_SQL} SELECT run_id AS entity, check_id, metric, round(actual, 6) AS actual, \"limit\", passed FROM bench")
def replay_benchmarks(spark, folder) -> DataFrame:
    return benchmarks(spark, folder).withColumn("actual", F.round("actual", 6))


_EXPERIMENT_SQL = """crit AS (SELECT user_id AS run_id, event_type AS experiment, event_id % 3 AS criterion, max(value) < 160 AS passed FROM events GROUP BY 1, 2, 3),
    recov AS (SELECT user_id AS run_id, event_type AS experiment, min(value) < 10 AS recovery_verified FROM events GROUP BY 1, 2),
    exps AS (SELECT r.run_id, r.experiment, CASE WHEN recovery_verified AND c.ok THEN 'passed' ELSE 'failed' END AS state
             FROM recov r JOIN (SELECT run_id, experiment, bool_and(passed) AS ok FROM crit GROUP BY 1, 2) c ON r.run_id = c.run_id AND r.experiment = c.experiment)"""


def experiments(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events").withColumn(
        "experiment", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    )
    criteria = rows.groupBy("experiment", (F.col("event_id") % 3).alias("criterion")).agg((F.max("value") < 160).alias("passed"))
    recoveries = rows.groupBy("experiment").agg((F.min("value") < 10).alias("recovery_verified"))
    states = gates.experiment_states(criteria, recoveries)
    parts = F.split("experiment", "/")
    return states.select(parts[0].cast("bigint").alias("run_id"), parts[1].alias("name"), "state")


@check("gat9_experiment_states", f"WITH {_EXPERIMENT_SQL} SELECT run_id, experiment AS name, state FROM exps")
def experiment_states(spark, folder) -> DataFrame:
    return experiments(spark, folder)


_SCORE_SQL = f"""{_BENCH_SQL}, {_EXPERIMENT_SQL},
    inp AS (SELECT user_id AS run_id, max(value) / 6 AS dev, count(*) % 3 <> 0 AS anomaly_ok FROM events GROUP BY 1),
    b AS (SELECT run_id, count(*) FILTER (passed) * 5.0::DOUBLE AS bs, coalesce(string_agg('Benchmark FAILED: ' || check_id, '; ' ORDER BY check_id) FILTER (NOT passed), '') AS bf FROM bench GROUP BY 1),
    e AS (SELECT run_id, count(*) FILTER (state = 'passed') * (50.0::DOUBLE / 7) AS es,
          coalesce(string_agg('Experiment FAILED: ' || experiment || ' (state=failed)', '; ' ORDER BY experiment) FILTER (state <> 'passed'), '') AS ef FROM exps GROUP BY 1),
    sc AS (SELECT i.run_id, bs, es, CASE WHEN dev <= 20 THEN 10.0::DOUBLE WHEN dev <= 40 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS ss,
                  CASE WHEN anomaly_ok THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS an, bf, ef, dev, anomaly_ok
           FROM inp i JOIN b ON b.run_id = i.run_id JOIN e ON e.run_id = i.run_id)"""


def _score(spark, folder) -> DataFrame:
    inputs = table(spark, folder, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        (F.max("value") / 6).alias("deviation_pct"), (F.count(F.lit(1)) % 3 != 0).alias("anomaly_ok")
    )
    bench = benchmarks(spark, folder).select(F.col("entity").alias("run_id"), F.col("check_id").alias("name"), "passed")
    return gates.resilience_score(bench, experiments(spark, folder), inputs)


@check(
    "agg20_resilience_score",
    f"""WITH {_SCORE_SQL} SELECT run_id, CAST(round_even(bs + es + ss + an, 0) AS INTEGER) AS score, round_even(bs + es + ss + an, 0) >= 95 AS passed,
           bs AS benchmark_score, round(es, 2) AS experiment_score, ss AS stability_score, an AS anomaly_score FROM sc""",
)
def resilience_score(spark, folder) -> DataFrame:
    return _score(spark, folder).drop("blocking_failures")


@check(
    "gat2_blocking_failures",
    f"""WITH {_SCORE_SQL} SELECT run_id, concat_ws('; ', nullif(bf, ''), nullif(ef, ''), CASE WHEN NOT anomaly_ok THEN 'Anomaly detector failed calibration check' END,
           CASE WHEN dev > 40 THEN format('Risk model drift too high: {{:.1f}}% > 40%', dev) END) AS blocking_failures FROM sc""",
)
def blocking_failures(spark, folder) -> DataFrame:
    return _score(spark, folder).select("run_id", "blocking_failures")


# --- pre-flight and post-cutover -------------------------------------------

_FLIGHT_SQL = """m AS (SELECT user_id AS entity, min(value) * 10 AS replication_lag_seconds, max(value) * 20 AS risk_p95_usd, max(value) / 400 AS anomaly_score,
           CAST(count(*) % 40 AS DOUBLE) AS merkle_age_minutes, CAST(count(*) % 4 AS DOUBLE) AS quorum_nodes, CAST(count(*) % 2 AS DOUBLE) AS healthy_brokers FROM events GROUP BY 1),
    sig AS (SELECT DISTINCT user_id AS entity, 'PF-0' || lpad(CAST(7 + event_id % 4 AS VARCHAR), 2, '0') AS check_id FROM events WHERE event_type = 'click' AND event_id % 3 = 0),
    items AS (""" + " UNION ALL ".join(
    f"SELECT entity, '{check}' AS check_id, TRUE AS automated, CASE WHEN {metric} {op} {limit} THEN 'green' ELSE 'red' END AS status FROM m"
    for check, metric, op, limit in V.PREFLIGHT_RULES
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT entity, '{c}', FALSE, CASE WHEN EXISTS (SELECT 1 FROM sig WHERE sig.entity = m.entity AND sig.check_id = '{c}') THEN 'green' ELSE 'manual' END FROM m"
    for c in V.PREFLIGHT_MANUAL
) + ")"


def flight_items(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events")
    n = F.count(F.lit(1))
    wide = rows.groupBy("user_id").agg(
        (F.min("value") * 10).alias("replication_lag_seconds"), (F.max("value") * 20).alias("risk_p95_usd"),
        (F.max("value") / 400).alias("anomaly_score"), (n % 40).alias("merkle_age_minutes"),
        (n % 4).alias("quorum_nodes"), (n % 2).alias("healthy_brokers"),
    )
    metrics = timeline.as_long(wide, "user_id", [metric for _, metric, _, _ in V.PREFLIGHT_RULES])
    number = F.lpad((7 + F.col("event_id") % 4).cast("string"), 2, "0")
    signoffs = rows.where("event_type = 'click' and event_id % 3 = 0").select(
        F.col("user_id").alias("entity"), F.concat(F.lit("PF-0"), number).alias("check_id")
    )
    return gates.preflight(metrics, signoffs)


@check("gat3_preflight_items", f"WITH {_FLIGHT_SQL} SELECT * FROM items")
def preflight_items(spark, folder) -> DataFrame:
    return flight_items(spark, folder)


@check(
    "gat3_preflight_verdict",
    f"""WITH {_FLIGHT_SQL} SELECT entity, bool_and(status = 'green') AS all_green,
           coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (automated AND status = 'red'), '') AS blocking_items,
           coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (status = 'manual'), '') AS manual_items_pending FROM items GROUP BY 1""",
)
def preflight_verdict(spark, folder) -> DataFrame:
    return gates.preflight_verdict(flight_items(spark, folder))


_LIVE_AT = "2024-01-20 00:00:00"


@check(
    "gat3_preflight_sustained",
    f"""WITH s AS (SELECT user_id % 12 AS entity, ts, value / 150 AS lag, CAST(event_id % 4 AS DOUBLE) AS nodes FROM events WHERE ts <= TIMESTAMP '{_LIVE_AT}'),
        r AS (SELECT entity, min(ts) AS since, max(lag) FILTER (ts >= TIMESTAMP '{_LIVE_AT}' - INTERVAL 4 HOUR) AS worst, arg_max(nodes, ts) AS nodes FROM s GROUP BY 1),
        v AS (SELECT entity, CASE WHEN since <= TIMESTAMP '{_LIVE_AT}' - INTERVAL 4 HOUR THEN worst END AS lag, nodes FROM r)
        SELECT entity, 'replication_lag_seconds' AS metric, lag AS value, coalesce(lag <= 5.0, FALSE) AS passed FROM v
        UNION ALL SELECT entity, 'quorum_nodes', nodes, nodes >= 2 FROM v""",
)
def preflight_sustained(spark, folder) -> DataFrame:
    """The lag has to keep its limit for four hours; of the number of nodes the last value counts."""
    rows = table(spark, folder, "events")
    pairs = F.array(
        F.struct(F.lit("replication_lag_seconds").alias("metric"), (F.col("value") / 150).alias("value")),
        F.struct(F.lit("quorum_nodes").alias("metric"), (F.col("event_id") % 4).cast("double").alias("value")),
    )
    samples = rows.select((F.col("user_id") % 12).alias("entity"), "ts", F.inline(pairs))
    metrics = gates.sustained_metrics(samples, "ts", F.to_timestamp_ntz(F.lit(_LIVE_AT)))
    rules = [r for r in V.PREFLIGHT_RULES if r[1] in ("replication_lag_seconds", "quorum_nodes")]
    items = gates.preflight(metrics, spark.createDataFrame([], "entity bigint, check_id string"), rules, ["PF-007"]).where("automated")
    names = F.create_map(*[F.lit(x) for r in rules for x in r[:2]])
    status = items.select("entity", F.element_at(names, F.col("check_id")).alias("metric"), (F.col("status") == "green").alias("passed"))
    return metrics.join(status, ["entity", "metric"]).select("entity", "metric", "value", "passed")


_POST_SQL = """m AS (SELECT user_id || ':' || (event_id % 5) AS entity, user_id % 2 AS ph, max(value) * 3 AS p99_latency_ms, count(*) FILTER (value > 220) * 0.06::DOUBLE AS error_rate_pct,
           max(CASE WHEN event_id % 50 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS merkle_divergence_pct, max(value) / 300 AS anomaly_score, CAST(count(*) * 3 % 100 AS DOUBLE) AS conn_pool_pct
           FROM events GROUP BY 1, 2),
    checks AS (""" + " UNION ALL ".join(
    f"SELECT entity, ph, '{check}' AS check_id, {metric} {op} {limit} AS passed FROM m" for check, metric, op, limit in V.POST_CUTOVER_RULES
) + "), verdicts AS (SELECT entity, ph, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (NOT passed), '') AS blocking FROM checks GROUP BY 1, 2)"


def _post_metrics(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events")
    name = F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string"))
    n = F.count(F.lit(1))
    return rows.groupBy(name.alias("entity")).agg(
        (F.max("value") * 3).alias("p99_latency_ms"), (F.count_if(F.col("value") > 220) * F.lit(0.06)).alias("error_rate_pct"),
        F.max(F.when(F.col("event_id") % 50 == 0, 0.1).otherwise(0.0)).alias("merkle_divergence_pct"),
        (F.max("value") / 300).alias("anomaly_score"), (n * 3 % 100).alias("conn_pool_pct"),
    )


def _post_verdicts(spark, folder) -> DataFrame:
    names = [metric for _, metric, _, _ in V.POST_CUTOVER_RULES]
    results = gates.evaluate_gate(timeline.as_long(_post_metrics(spark, folder), "entity", names), V.POST_CUTOVER_RULES)
    return gates.gate_verdict(results)


@check("gat4_post_cutover_checks", f"WITH {_POST_SQL} SELECT entity, passed, failed, blocking FROM verdicts")
def post_cutover_checks(spark, folder) -> DataFrame:
    return _post_verdicts(spark, folder)


@check(
    "agg21_post_cutover_report",
    f"""WITH {_POST_SQL} SELECT coalesce(bool_and(passed) FILTER (ph = 0), FALSE) AS immediate_window_passed, coalesce(bool_and(passed) FILTER (ph = 1), FALSE) AS extended_window_passed,
           count(*) AS total_checkpoints, count(*) FILTER (NOT passed) AS failed_checkpoints, (SELECT count(*) FROM m) AS merkle_verifications,
           (SELECT bool_and(merkle_divergence_pct <= 0) FROM m) AS merkle_all_clean, (SELECT count(*) FROM events) AS spot_checks_run,
           (SELECT count(*) FROM events WHERE value < 200) AS spot_checks_passed, FALSE AS edge_decommission_safe FROM verdicts""",
)
def post_cutover_report(spark, folder) -> DataFrame:
    user = F.split("entity", ":")[0].cast("bigint")
    points = _post_verdicts(spark, folder).select(F.when(user % 2 == 0, "immediate").otherwise("extended").alias("phase"), "passed")
    trees = _post_metrics(spark, folder).select(F.col("merkle_divergence_pct").alias("divergence_pct"))
    spots = table(spark, folder, "events").select((F.col("value") < 200).alias("passed"))
    return gates.post_cutover_report(points, trees, spots)


@check(
    "set3_checkpoint_union",
    f"""WITH {_POST_SQL} SELECT phase, count(*) AS n_rows, count(note) AS noted FROM (
            SELECT 'immediate' AS phase, entity, NULL AS note FROM verdicts UNION ALL SELECT 'extended', entity, blocking FROM verdicts) GROUP BY 1""",
)
def checkpoint_union(spark, folder) -> DataFrame:
    """Two kinds of checkpoint rows with different columns, appended by name."""
    rows = _post_verdicts(spark, folder)
    first = rows.select(F.lit("immediate").alias("phase"), "entity")
    second = rows.select(F.lit("extended").alias("phase"), "entity", F.col("blocking").alias("note"))
    both = first.unionByName(second, allowMissingColumns=True)
    return both.groupBy("phase").agg(F.count(F.lit(1)).alias("n_rows"), F.count("note").alias("noted"))


# --- configuration and alerts ----------------------------------------------

@check(
    "gat7_retention_rules",
    """WITH r AS (SELECT 'cdc.shop.' || user_id AS resource, CASE WHEN user_id % 5 = 0 THEN -1 ELSE count(*) % 12 * 86400000 END AS retention_ms FROM events GROUP BY user_id)
       SELECT resource, CAST(retention_ms AS BIGINT) AS retention_ms, retention_ms = -1 OR retention_ms >= 604800000 AS passed FROM r""",
)
def retention_rules(spark, folder) -> DataFrame:
    user = F.col("user_id")
    settings = table(spark, folder, "events").groupBy(user).agg((F.count(F.lit(1)) % 12 * 86_400_000).alias("ms")).select(
        F.concat(F.lit("cdc.shop."), user.cast("string")).alias("resource"), F.lit("retention.ms").alias("key"),
        F.when(user % 5 == 0, -1).otherwise(F.col("ms")).cast("string").alias("value"),
    )
    return gates.retention_rules(settings)


@check(
    "gat7_source_log_rules",
    """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
       SELECT 'db' || user_id AS resource, s.setting, CASE s.setting WHEN 'binlog_format' THEN n % 7 <> 0 WHEN 'binlog_row_image' THEN TRUE WHEN 'gtid_mode' THEN user_id % 9 <> 0
              WHEN 'enforce_gtid_consistency' THEN TRUE ELSE n % 15 >= 7 END AS passed
       FROM u, (VALUES ('binlog_format'), ('binlog_row_image'), ('gtid_mode'), ('enforce_gtid_consistency'), ('expire_logs_days')) s(setting)""",
)
def source_log_rules(spark, folder) -> DataFrame:
    user, n = F.col("user_id"), F.col("n")
    counted = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    def setting(key: str, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    values = F.array_compact(
        F.array(
            setting("binlog_format", F.when(n % 7 == 0, "STATEMENT").otherwise("row")), setting("binlog_row_image", F.lit("FULL")),
            F.when(user % 9 != 0, setting("gtid_mode", F.lit("on"))), setting("enforce_gtid_consistency", F.lit("ON")),
            setting("expire_logs_days", n % 15),
        )
    )
    rows = counted.select(F.concat(F.lit("db"), user.cast("string")).alias("resource"), F.explode(values).alias("_s"))
    return gates.source_log_rules(rows.select("resource", "_s.*"))


_ALERT_METRICS = {"anomaly_score": "mx / 250", "replication_lag_seconds": "mx", "conn_pool_pct": "mx", "buffer_pool_hit_rate_pct": "100 - mn / 4", "p99_insert_latency_ms": "mx * 6"}
_ALERT_IN = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'writers' ELSE 'readers' END"
_ALERT_OPS = {a: (m, op, limit, sev, ack, minutes) for a, m, op, limit, sev, ack, minutes in V.ALERT_RULES if m in _ALERT_METRICS}
_ALERT_SQL = f"""s AS (SELECT {_ALERT_IN} AS entity, (epoch_us(ts) // 300000000) * 300000000 AS us, max(value) AS mx, min(value) AS mn FROM events GROUP BY 1, 2),
    tagged AS (""" + " UNION ALL ".join(
    f"SELECT entity, us, '{a}' AS alert, '{m}' AS metric, '{sev}' AS severity, {ack} AS ack_minutes, {minutes} * 60000000 AS width, {_ALERT_METRICS[m]} AS v, {_ALERT_METRICS[m]} {op} {limit} AS broken FROM s"
    for a, (m, op, limit, sev, ack, minutes) in _ALERT_OPS.items()
) + """), firing AS (
    SELECT *, broken AND CASE width WHEN 0 THEN TRUE WHEN 600000000 THEN all_10 AND us - since_10 >= width
           WHEN 900000000 THEN all_15 AND us - since_15 >= width ELSE all_30 AND us - since_30 >= width END AS firing
    FROM (SELECT *, """ + ", ".join(
    f"bool_and(broken) OVER w{m} AS all_{m}, min(us) OVER w{m} AS since_{m}" for m in (10, 15, 30)
) + """ FROM tagged WINDOW """ + ", ".join(
    f"w{m} AS (PARTITION BY entity, alert ORDER BY us RANGE BETWEEN {m * 60_000_000} PRECEDING AND CURRENT ROW)" for m in (10, 15, 30)
) + """)),
    seen AS (SELECT *, coalesce(lag(firing) OVER (PARTITION BY entity, alert ORDER BY us), FALSE) AS before FROM firing)"""


@check(
    "gat10_alert_starts",
    f"WITH {_ALERT_SQL} SELECT entity, alert, metric, severity, ack_minutes, round(v, 6) AS value, us FROM seen WHERE firing AND NOT before",
)
def alert_starts(spark, folder) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = (at - F.pmod(at, F.lit(300_000_000))).alias("us")
    side = F.when(F.col("event_type").isin("purchase", "signup"), "writers").otherwise("readers")
    slots = table(spark, folder, "events").groupBy(side.alias("entity"), slot).agg(F.max("value").alias("mx"), F.min("value").alias("mn"))
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in _ALERT_METRICS.items()]
    )
    metrics = slots.select("entity", F.timestamp_micros("us").alias("ts"), F.explode(pairs).alias("_m")).select("entity", "ts", "_m.*")
    return gates.fire_alerts(metrics, "ts").select(
        "entity", "alert", "metric", "severity", "ack_minutes", F.round("value", 6).alias("value"), F.unix_micros("ts").alias("us")
    )


@check(
    "gat8_apply_exit",
    f"""WITH {SERIES_SQL}, {EDGE_SQL}, {TARGET_SQL}, w AS (SELECT *, max(mn) OVER f AS worst, min(us) OVER f AS since FROM series
            WINDOW f AS (PARTITION BY run_id ORDER BY us RANGE BETWEEN {4 * 3_600_000_000} PRECEDING AND CURRENT ROW)),
        h AS (SELECT CAST(bool_or(worst <= 30 AND us - since >= {4 * 3_600_000_000}) AS INTEGER)::DOUBLE AS v FROM w),
        par AS (SELECT round(abs((SELECT count(*) FROM edge) - (SELECT count(*) FROM target))::DOUBLE / (SELECT count(*) FROM edge) * 100, 6) AS v)
        SELECT 'apply' AS entity, 'EX-1' AS check_id, 'lag_held' AS metric, h.v AS actual, 1.0::DOUBLE AS "limit", h.v >= 1 AS passed FROM h
        UNION ALL SELECT 'apply', 'EX-2', 'parity_pct', par.v, 0.001, par.v <= 0.001 FROM par
        UNION ALL SELECT 'apply', 'EX-3', 'idempotent', 1.0, 1.0, TRUE""",
)
def apply_exit(spark, folder) -> DataFrame:
    """Lag held for four hours, row parity and idempotency as one gate."""
    held = timeline.sustained(hourly(spark, folder), "ts", "mn", "<=", 30.0, 4, ["run_id"]).agg(
        F.max(F.col("sustained").cast("double")).alias("value")
    )
    parity = snapshot.row_parity(edge_orders(spark, folder), target_orders(spark, folder)).select(F.col("difference_pct").alias("value"))
    twice = cdc.idempotency_audit(stale_target(spark, folder), good_log(spark, folder), ["o_orderkey"]).select(
        F.col("passed").cast("double").alias("value")
    )
    parts = [held.withColumn("metric", F.lit("lag_held")), parity.withColumn("metric", F.lit("parity_pct")), twice.withColumn("metric", F.lit("idempotent"))]
    metrics = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("entity", F.lit("apply"))
    rules = [("EX-1", "lag_held", ">=", 1.0), ("EX-2", "parity_pct", "<=", V.ROW_PARITY_PCT), ("EX-3", "idempotent", ">=", 1.0)]
    return gates.evaluate_gate(metrics, rules)


# --- wind-down -------------------------------------------------------------

_WIND_SQL = f"""{QUERY_SQL}, refs AS (SELECT doc_id, doc_id % 7 <> 0 AS resolved FROM documents WHERE contains(text, 'license') OR contains(text, '@')
            OR contains(text, 'https') OR contains(text, 'the ') OR contains(text, 'que')),
    late AS (SELECT * FROM qlog WHERE verb IN ('INSERT', 'UPDATE', 'DELETE') AND ts > TIMESTAMP '2024-01-15'),
    status AS (SELECT (SELECT count(*) FROM refs) AS orphans_found, (SELECT count(*) FROM refs WHERE NOT resolved) AS orphans_unresolved,
           (SELECT count(*) FROM late) AS write_attempts, (SELECT coalesce(bool_or(value > 400) FILTER (event_type = 'purchase'), FALSE) FROM events) AS backup_completed,
           (SELECT coalesce(bool_or(value > 100) FILTER (event_type = 'view'), FALSE) FROM events) AS log_archived, 15.0::DOUBLE AS days_elapsed, 'day_10' AS current_day)"""


def _status(spark, folder) -> DataFrame:
    refs = reference_scan(spark, folder).withColumn("resolved", F.col("doc_id") % 7 != 0)
    late = query_log(spark, folder).where(
        (F.col("verb") != "SELECT") & (F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))
    )
    rows = table(spark, folder, "events")
    artifacts = rows.where("event_type in ('purchase', 'view')").select(
        F.when(F.col("event_type") == "purchase", "backup").otherwise("log_archive").alias("kind"),
        F.when(F.col("event_type") == "purchase", F.col("value") > 400).otherwise(F.col("value") > 100).alias("done"),
    )
    return gates.decommission_status(15.0, refs, late, artifacts)


@check(
    "agg28_decommission_status",
    f"""WITH {_WIND_SQL} SELECT *, orphans_unresolved = 0 AND backup_completed AND log_archived AND write_attempts = 0 AS safe_to_terminate FROM status""",
)
def decommission_status(spark, folder) -> DataFrame:
    return _status(spark, folder)


@check(
    "gat6_decommission_checklist",
    f"""WITH {_WIND_SQL}, c AS (SELECT unnest([
            {{'position': 1, 'step': 'read_only', 'status': 'COMPLETE'}}, {{'position': 2, 'step': 'no_write_attempts', 'status': CASE WHEN write_attempts = 0 THEN 'COMPLETE' ELSE 'ACTION_REQUIRED' END}},
            {{'position': 3, 'step': 'connection_strings_removed', 'status': 'IN_PROGRESS'}}, {{'position': 4, 'step': 'replicas_offline', 'status': 'IN_PROGRESS'}},
            {{'position': 5, 'step': 'final_backup', 'status': CASE WHEN backup_completed THEN 'COMPLETE' ELSE 'PENDING' END}},
            {{'position': 6, 'step': 'log_archive', 'status': CASE WHEN log_archived THEN 'COMPLETE' ELSE 'PENDING' END}},
            {{'position': 7, 'step': 'no_references', 'status': CASE WHEN orphans_unresolved = 0 THEN 'COMPLETE' ELSE 'BLOCKING' END}},
            {{'position': 8, 'step': 'deletion_lock', 'status': 'LOCKED'}},
            {{'position': 9, 'step': 'terminate', 'status': CASE WHEN orphans_unresolved = 0 AND backup_completed AND log_archived AND write_attempts = 0 THEN 'SAFE' ELSE 'BLOCKED' END}},
            {{'position': 10, 'step': 'delete_volumes', 'status': 'SCHEDULED'}}]) AS s FROM status)
        SELECT s.position AS position, s.step AS step, s.status AS status FROM c""",
)
def decommission_checklist(spark, folder) -> DataFrame:
    return gates.decommission_checklist(_status(spark, folder)).select("position", "step", "status")


# --- closing report, one migration per user --------------------------------

_MIG_SQL = """mig AS (SELECT user_id AS migration_id, min(ts) AS started_at, max(ts) AS cutover_at, min(value) * 20 AS downtime_ms, max(value) * 3 AS actual_usd,
           CASE WHEN user_id % 6 = 0 THEN NULL ELSE 700.0::DOUBLE END AS estimate_usd, CAST(90 + count(*) % 11 AS INTEGER) AS resilience_score,
           count(*) FILTER (event_type = 'error' AND value > 150) AS class_a, count(*) FILTER (event_type = 'click' AND value < 50) AS passed,
           count(*) FILTER (event_type = 'click') AS tried, count(*) FILTER (event_type = 'signup' AND value > 120) AS pauses,
           count(*) FILTER (event_type = 'signup' AND value > 120 AND event_id % 2 = 0) AS auto FROM events GROUP BY user_id),
    summ AS (SELECT *, round((epoch_us(cutover_at) - epoch_us(started_at)) / 86400000000, 1) AS duration_days,
           round(abs(actual_usd - coalesce(estimate_usd, actual_usd)) / greatest(coalesce(estimate_usd, actual_usd), 0.01::DOUBLE) * 100, 2) AS cost_variance_pct FROM mig),
    evo AS (SELECT user_id AS migration_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 1500.0::DOUBLE END AS estimate_p50_usd, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 2000.0::DOUBLE END AS estimate_p95_usd,
           max(value) * 8 AS cutover_p95_usd, CASE WHEN user_id % 7 = 0 THEN 0.0::DOUBLE ELSE abs(max(value) * 8 - 2000) / 2000 * 100 END AS d FROM events GROUP BY user_id)"""


def _migrations(spark, folder):
    rows = table(spark, folder, "events").withColumnRenamed("user_id", "migration_id")
    key = F.col("migration_id")
    migrations = rows.groupBy(key).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("cutover_at"), (F.min("value") * 20).alias("downtime_ms"),
        (F.max("value") * 3).alias("actual_usd"), (F.lit(90) + F.count(F.lit(1)) % 11).cast("int").alias("resilience_score"),
        F.lit(0).alias("data_loss_events"),
    ).withColumn("estimate_usd", F.when(key % 6 != 0, 700.0))
    audits = rows.where("event_type = 'error'").select(key, F.when(F.col("value") > 150, "A").otherwise("NONE").alias("divergence_class"))
    tried = rows.where("event_type = 'click'").select(key, F.when(F.col("value") < 50, "passed").otherwise("failed").alias("state"))
    anomalies = rows.where("event_type = 'signup' and value > 120").select(
        key, F.when(F.col("event_id") % 2 == 0, "autonomous").otherwise("operator").alias("resolution")
    )
    summary = report.sre_summary(migrations, audits, tried, anomalies)
    cutovers = rows.groupBy(key).agg((F.max("value") * 8).alias("cutover_p95_usd"))
    estimates = cutovers.where(key % 7 != 0).select(key, F.lit(1500.0).alias("estimate_p50_usd"), F.lit(2000.0).alias("estimate_p95_usd"))
    return summary, report.risk_evolution(estimates, cutovers)


@check(
    "agg29_migration_summary",
    f"""WITH {_MIG_SQL} SELECT migration_id, duration_days, class_a AS class_a_divergences, passed AS experiments_passed, tried AS experiments_total,
           cost_variance_pct, pauses AS anomaly_pauses, auto AS autonomous_recoveries FROM summ""",
)
def migration_summary(spark, folder) -> DataFrame:
    summary, _ = _migrations(spark, folder)
    return summary.select(
        "migration_id", "duration_days", "class_a_divergences", "experiments_passed", "experiments_total",
        "cost_variance_pct", "anomaly_pauses", "autonomous_recoveries",
    )


@check(
    "joi8_estimate_vs_actual",
    f"WITH {_MIG_SQL} SELECT migration_id, estimate_p50_usd, estimate_p95_usd, round(cutover_p95_usd, 6) AS cutover_p95_usd, round(d, 2) AS deviation_pct FROM evo",
)
def estimate_vs_actual(spark, folder) -> DataFrame:
    _, evolution = _migrations(spark, folder)
    return evolution.select(
        "migration_id", "estimate_p50_usd", "estimate_p95_usd", F.round("cutover_p95_usd", 6).alias("cutover_p95_usd"), "deviation_pct"
    )


@check(
    "rpt2_cost_reconciliation",
    f"""WITH {_MIG_SQL} SELECT s.migration_id, round(actual_usd, 6) AS actual_usd, round(coalesce(estimate_usd, actual_usd), 6) AS estimate_usd, cost_variance_pct,
           actual_usd <= coalesce(estimate_p95_usd, actual_usd * 2) AS within_p95, CASE WHEN s.migration_id % 2 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS savings_usd
        FROM summ s JOIN evo e ON s.migration_id = e.migration_id""",
)
def cost_reconciliation(spark, folder) -> DataFrame:
    summary, evolution = _migrations(spark, folder)
    savings = summary.where(F.col("migration_id") % 2 == 0).select("migration_id", F.lit(5.0).alias("savings_usd"))
    found = report.cost_reconciliation(summary, evolution, savings)
    return found.withColumn("actual_usd", F.round("actual_usd", 6)).withColumn("estimate_usd", F.round("estimate_usd", 6))


@check(
    "rpt3_lessons",
    f"""WITH {_MIG_SQL} SELECT s.migration_id, CAST(CAST(downtime_ms < 100 AS INTEGER) + 1 + CAST(round(d, 2) > 20 AS INTEGER) + CAST(pauses > 0 AS INTEGER)
           + CAST(resilience_score < 100 AS INTEGER) + CAST(class_a > 0 AS INTEGER) AS BIGINT) AS lessons FROM summ s JOIN evo e ON s.migration_id = e.migration_id""",
)
def lessons(spark, folder) -> DataFrame:
    summary, evolution = _migrations(spark, folder)
    return report.lessons(summary, evolution).groupBy("migration_id").agg(F.count(F.lit(1)).alias("lessons"))


@check(
    "rpt3_recommendations",
    f"""WITH {_MIG_SQL}, r AS (SELECT s.migration_id, unnest(list_filter([{{'priority': 'HIGH', 'subject': 'anomaly model', 'use': TRUE}}, {{'priority': 'HIGH', 'subject': 'runbooks', 'use': TRUE}},
            {{'priority': 'MEDIUM', 'subject': 'risk estimate', 'use': round(d, 2) > 20}}, {{'priority': 'MEDIUM', 'subject': 'cost estimate', 'use': cost_variance_pct > 15}}], lambda x: x.use)) AS a
            FROM summ s JOIN evo e ON s.migration_id = e.migration_id)
        SELECT migration_id, a.priority AS priority, a.subject AS subject FROM r""",
)
def recommendations(spark, folder) -> DataFrame:
    summary, evolution = _migrations(spark, folder)
    return report.recommendations(summary, evolution).select("migration_id", "priority", "subject")
