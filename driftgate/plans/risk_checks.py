"""Rollback risk and cost routing on states, prices and writes read from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions import risk_rules
from driftgate.functions.clock import instant_us
from driftgate.operators import pricing, risk
from driftgate.operators.asof import asof_join
from driftgate.plans.inputs import normal_sql
from driftgate.plans.registry import check, table

_HOUR = 3_600_000_000

# --- states: one migration run for each three users, so that they grow with the table; the number of draws is the documented one ---

DRAWS = V.SIMULATIONS
_USERS = 3  # in a state

STATES_SQL = f"""st AS (
    SELECT user_id // {_USERS} AS state_id, CAST(100000000000 AS BIGINT) AS total_bytes, count(*) * 1000000000 AS bytes_done,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * 20000 AS write_rate, max(value) / 100 AS lag_seconds,
           300.0::DOUBLE AS merkle_seconds, 1.0::DOUBLE AS mean_gbps, 0.1::DOUBLE * (1 + (user_id // {_USERS}) % 3) AS std_gbps
    FROM events GROUP BY user_id // {_USERS})"""


def states(spark, folder, users: int = _USERS) -> DataFrame:
    group = F.call_function("div", F.col("user_id"), F.lit(users)).cast("bigint")
    return table(spark, folder, "events").groupBy(group.alias("state_id")).agg(
        F.lit(100_000_000_000).cast("bigint").alias("total_bytes"), (F.count(F.lit(1)) * 1_000_000_000).alias("bytes_done"),
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") * 20_000).alias("write_rate"),
        (F.max("value") / 100).alias("lag_seconds"),
    ).select(
        "*", F.lit(300.0).alias("merkle_seconds"), F.lit(1.0).alias("mean_gbps"),
        (F.lit(0.1) * (1 + F.col("state_id") % 3)).alias("std_gbps"),
    )


def cost_sql(states_name: str, n: int, seed: int = 0, state: str = "CAST(state_id AS VARCHAR)", per_hour: str = "") -> str:
    z = normal_sql(f"{state} || ':' || draw || ':{seed}'")
    rate = f"greatest(0.5::DOUBLE + std_gbps * 0.5::DOUBLE * {z}, 0.005::DOUBLE){per_hour}"
    return f"""drawn AS (SELECT *, {rate} AS tp FROM {states_name}, (SELECT unnest(range({n})) AS draw)),
    costs AS (SELECT *, bytes_done / 1e9 * 0.09::DOUBLE
        + ((lag_seconds * write_rate) / 1e9 / tp + (60.0::DOUBLE / 3600 + (lag_seconds * write_rate) / 1e9 / tp)
           + (merkle_seconds * write_rate * 0.001::DOUBLE) / 1e9 / tp) * 5000 AS cost FROM drawn)"""


_VERDICT_SQL = """round(p[1], 2) AS p5_usd, round(p[2], 2) AS p50_usd, round(p[3], 2) AS p95_usd, round(p[4], 2) AS p99_usd,
    p[3] < 5000 AS rollback_feasible,
    CASE WHEN p[3] >= 5000 THEN 0.0::DOUBLE WHEN total_bytes - bytes_done <= 0 THEN NULL ELSE round((5000 - p[3]) / (mean_gbps * 0.09::DOUBLE), 0) END AS event_horizon_seconds,
    round(CAST(bytes_done AS DOUBLE) / total_bytes * 100, 2) AS progress_pct,
    CASE WHEN p[3] >= 5000 THEN 'BLOCK' WHEN p[3] >= 4000 THEN 'CAUTION' ELSE 'PROCEED' END AS recommendation"""
_VERDICT = [
    "p5_usd", "p50_usd", "p95_usd", "p99_usd", "rollback_feasible", "event_horizon_seconds", "progress_pct", "recommendation",
]


@check(
    "sim1_cost_draws",
    f"""WITH {STATES_SQL}, {cost_sql('st', DRAWS)} SELECT state_id, count(*) AS n_draws, round(min(cost), 4) AS lowest,
        round(max(cost), 4) AS highest, round(avg(cost), 4) AS mean FROM costs GROUP BY 1""",
)
def cost_draws(spark, folder) -> DataFrame:
    return risk.simulate_cost(states(spark, folder), DRAWS, method="md5").groupBy("state_id").agg(
        F.count(F.lit(1)).alias("n_draws"), F.round(F.min("cost"), 4).alias("lowest"),
        F.round(F.max("cost"), 4).alias("highest"), F.round(F.avg("cost"), 4).alias("mean"),
    )


@check(
    "sim1_cost_draws_unit_fix",
    f"""WITH {STATES_SQL}, {cost_sql('st', DRAWS, 7, per_hour=' * 450.0::DOUBLE')} SELECT state_id, round(avg(cost), 6) AS mean FROM costs GROUP BY 1""",
)
def cost_draws_fixed(spark, folder) -> DataFrame:
    drawn = risk.simulate_cost(states(spark, folder), DRAWS, seed=7, unit_fix=True, method="md5")
    return drawn.groupBy("state_id").agg(F.round(F.avg("cost"), 6).alias("mean"))


@check(
    "sim2_evaluate_risk",
    f"""WITH {STATES_SQL}, {cost_sql('st', DRAWS)}, q AS (SELECT state_id, quantile_cont(cost, [0.05, 0.5, 0.95, 0.99]) AS p FROM costs GROUP BY 1)
        SELECT state_id, {_VERDICT_SQL}, round(greatest(0, least(1, 1 - std_gbps / mean_gbps)), 3) AS network_health FROM st JOIN q USING (state_id)""",
)
def evaluate_risk(spark, folder) -> DataFrame:
    return risk.evaluate_risk(states(spark, folder), DRAWS, method="md5").select("state_id", *_VERDICT, "network_health")


@check("sim2_evaluate_risk_fast_draws")
def evaluate_risk_fast(spark, folder) -> DataFrame:
    """The default draws, which other engines cannot repeat, at the full number per state and a state for each user."""
    return risk.evaluate_risk(states(spark, folder, users=1)).select("state_id", *_VERDICT)


@check(
    "agg7_cost_percentiles",
    f"""WITH {STATES_SQL}, {cost_sql('st', DRAWS, 3)} SELECT state_id, round(quantile_cont(cost, 0.05), 2) AS p5_usd, round(quantile_cont(cost, 0.5), 2) AS p50_usd,
        round(quantile_cont(cost, 0.95), 2) AS p95_usd, round(quantile_cont(cost, 0.99), 2) AS p99_usd, round(avg(cost), 2) AS mean_usd, round(stddev_pop(cost), 2) AS std_usd
        FROM costs GROUP BY 1""",
)
def cost_percentiles(spark, folder) -> DataFrame:
    return risk.evaluate_risk(states(spark, folder), DRAWS, seed=3, method="md5").select(
        "state_id", "p5_usd", "p50_usd", "p95_usd", "p99_usd", "mean_usd", "std_usd"
    )


@check(
    "sim3_pre_migration_curve",
    f"""WITH {STATES_SQL}, cp AS (SELECT state_id AS run_id, total_bytes, write_rate, mean_gbps, std_gbps, unnest([0.25, 0.5, 0.75, 0.9, 0.95, 1.0])::DOUBLE AS progress FROM st),
        cs AS (SELECT run_id || '@' || CAST(round(progress * 100) AS INTEGER) AS state_id, *, CAST(floor(total_bytes * progress) AS BIGINT) AS bytes_done,
               least(progress * 30, 120) AS lag_seconds, 300.0::DOUBLE AS merkle_seconds FROM cp),
        {cost_sql('cs', DRAWS, state='state_id')}, q AS (SELECT state_id, quantile_cont(cost, [0.05, 0.5, 0.95, 0.99]) AS p FROM costs GROUP BY 1)
        SELECT state_id, {_VERDICT_SQL} FROM cs JOIN q USING (state_id)""",
)
def pre_migration_curve(spark, folder) -> DataFrame:
    runs = states(spark, folder).select(F.col("state_id").alias("run_id"), "total_bytes", "write_rate", "mean_gbps", "std_gbps")
    return risk.pre_migration_estimate(runs, DRAWS, method="md5").select("state_id", *_VERDICT)


@check(
    "agg34_time_estimate",
    f"""WITH {STATES_SQL} SELECT state_id, round(bytes_done / 1e9 / greatest(std_gbps * 3, 0.001), 1) AS p50_hours,
        round(bytes_done / 1e9 / greatest(std_gbps * 3 - 2 * std_gbps, 0.001), 1) AS p95_hours FROM st""",
)
def time_estimate(spark, folder) -> DataFrame:
    hours = risk_rules.time_estimate_hours(F.col("bytes_done"), F.col("std_gbps") * 3, F.col("std_gbps"))
    return states(spark, folder).select("state_id", hours["p50"].alias("p50_hours"), hours["p95"].alias("p95_hours"))


# --- scalar rules, one per event -------------------------------------------

@check(
    "prj17_risk_band",
    """SELECT event_id, CASE WHEN value * 30 >= 5000 THEN 'BLOCK' WHEN value * 30 >= 4000 THEN 'CAUTION' ELSE 'PROCEED' END AS band,
              value * 30 < 5000 AS feasible FROM events""",
)
def risk_band(spark, folder) -> DataFrame:
    p95 = F.col("value") * 30
    return table(spark, folder, "events").select(
        "event_id", risk_rules.risk_band(p95).alias("band"), risk_rules.rollback_feasible(p95).alias("feasible")
    )


@check(
    "prj18_network_health",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(greatest(0, least(1, 1 - (event_id % 50) / value)), 6) END AS health FROM events""",
)
def network_health(spark, folder) -> DataFrame:
    mean = F.when(F.col("event_id") % 10 == 0, F.lit(0.0)).otherwise(F.col("value"))
    health = risk_rules.network_health(mean, (F.col("event_id") % 50).cast("double"))
    return table(spark, folder, "events").select("event_id", F.round(health, 6).alias("health"))


@check(
    "prj19_event_horizon",
    """SELECT event_id, CASE WHEN value * 30 >= 5000 THEN 0.0::DOUBLE WHEN event_id % 7 - 1 <= 0 THEN NULL WHEN event_id % 3 = 0 THEN NULL
              ELSE round((5000 - value * 30) / ((event_id % 3) * 0.5::DOUBLE * 0.09::DOUBLE), 0) END AS batch_horizon,
              CASE WHEN value * 30 >= 5000 THEN 0.0::DOUBLE WHEN event_id % 3 = 0 THEN NULL
              ELSE round((5000 - value * 30) / ((event_id % 3) * 0.5::DOUBLE * 0.09::DOUBLE), 0) END AS live_horizon FROM events""",
)
def event_horizon(spark, folder) -> DataFrame:
    p95, mean, left = F.col("value") * 30, (F.col("event_id") % 3) * F.lit(0.5), F.col("event_id") % 7 - 1
    return table(spark, folder, "events").select(
        "event_id", risk_rules.seconds_to_limit(p95, mean, left).alias("batch_horizon"),
        risk_rules.seconds_to_limit(p95, mean).alias("live_horizon"),
    )


@check(
    "prj20_progress",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE round((event_id % 13)::DOUBLE / (event_id % 5) * 100, 6) END AS progress FROM events""",
)
def progress(spark, folder) -> DataFrame:
    done, total = F.col("event_id") % 13, F.col("event_id") % 5
    return table(spark, folder, "events").select("event_id", F.round(risk_rules.progress_pct(done, total), 6).alias("progress"))


@check(
    "prj23_day_phase",
    """SELECT event_id, CASE WHEN d < 3 THEN 'day_1_3' WHEN d < 7 THEN 'day_4_7' WHEN d < 10 THEN 'day_8_9' ELSE 'day_10' END AS phase
       FROM (SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS d FROM events)""",
)
def day_phase(spark, folder) -> DataFrame:
    start = instant_us("2024-01-01")
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 86_400_000_000)
    return table(spark, folder, "events").select("event_id", risk_rules.day_phase(days).alias("phase"))


@check(
    "prj27_accuracy_bands",
    """SELECT event_id, round(d, 6) AS deviation_pct, CASE WHEN d <= 10 THEN 'EXCELLENT' WHEN d <= 20 THEN 'GOOD' WHEN d <= 40 THEN 'ACCEPTABLE' ELSE 'REVIEW' END AS band,
              CASE WHEN d > 40 THEN 3 WHEN d > 20 THEN 2 ELSE 1 END AS factors
       FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE abs(value - (30 + event_id % 20)) / (30 + event_id % 20) * 100 END AS d FROM events)""",
)
def accuracy_bands(spark, folder) -> DataFrame:
    estimate = F.when(F.col("event_id") % 9 == 0, F.lit(0.0)).otherwise((30 + F.col("event_id") % 20).cast("double"))
    off = risk_rules.deviation_pct(F.col("value"), estimate)
    return table(spark, folder, "events").select(
        "event_id", F.round(off, 6).alias("deviation_pct"),
        F.regexp_extract(risk_rules.accuracy_band(off), "^[A-Z]+", 0).alias("band"),
        F.size(risk_rules.deviation_factors(off)).alias("factors"),
    )


# --- risk bands over time --------------------------------------------------

SERIES_SQL = """series AS (
    SELECT event_type AS run_id, (epoch_us(ts) // 3600000000) * 3600000000 AS us, count(*) AS n, max(value) AS mx, min(value) AS mn
    FROM events GROUP BY 1, 2)"""


def hourly(spark, folder) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = (at - F.pmod(at, F.lit(_HOUR))).alias("us")
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("run_id"), hour).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("mx"), F.min("value").alias("mn")
    ).withColumn("ts", F.timestamp_micros("us"))


@check(
    "win5_band_transitions",
    f"""WITH {SERIES_SQL}, b AS (SELECT run_id, us, CASE WHEN mx * 30 >= 5000 THEN 'BLOCK' WHEN mx * 30 >= 4000 THEN 'CAUTION' ELSE 'PROCEED' END AS band FROM series),
        p AS (SELECT *, coalesce(lag(band) OVER (PARTITION BY run_id ORDER BY us), 'PROCEED') AS previous FROM b)
        SELECT * FROM (SELECT run_id, us, band, previous, CASE WHEN band = 'BLOCK' AND previous <> 'BLOCK' THEN 'on_block' WHEN band = 'CAUTION' AND previous = 'PROCEED' THEN 'on_caution'
               WHEN band = 'PROCEED' AND previous <> 'PROCEED' THEN 'on_proceed' END AS alert FROM p) WHERE alert IS NOT NULL""",
)
def band_transitions(spark, folder) -> DataFrame:
    banded = hourly(spark, folder).select("run_id", "us", risk_rules.risk_band(F.col("mx") * 30).alias("band"))
    return risk.band_transitions(banded, ["us"], band="band")


# --- prices and writes -----------------------------------------------------

PRICES_SQL = """prices AS (
    SELECT make_timestamp(us) AS price_ts, us, CASE (us // 3600000000) % 6 WHEN 0 THEN 0.18 WHEN 3 THEN 0.135 ELSE 0.09 END::DOUBLE AS price
    FROM (SELECT DISTINCT (epoch_us(ts) // 3600000000) * 3600000000 AS us FROM events) WHERE (us // 3600000000) % 4 <> 1)"""
WRITES_SQL = """writes AS (
    SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'payments' WHEN 'signup' THEN 'users' WHEN 'click' THEN 'Analytics_Events'
           WHEN 'view' THEN 'page_views' ELSE 'unknown_' || (user_id % 3) END AS table_name, CAST(1000 + round(value * 100) AS BIGINT) AS bytes FROM events)"""
_CLASS_SQL = "CASE WHEN lower(table_name) IN ('analytics_events', 'page_views') THEN 'non_critical' ELSE 'critical' END"
ROUTED_SQL = f"""{PRICES_SQL}, {WRITES_SQL}, routed AS (
    SELECT w.*, coalesce(p.price, 0.09::DOUBLE) AS price, {_CLASS_SQL} AS write_class,
           CASE WHEN w.ts >= TIMESTAMP '2024-01-28' THEN 'deadline_override' WHEN {_CLASS_SQL} = 'critical' THEN 'flow_immediately'
                WHEN coalesce(p.price, 0.09::DOUBLE) / 0.09::DOUBLE >= 1.5 THEN 'buffer_to_wal' ELSE 'flow_immediately' END AS decision
    FROM writes w ASOF LEFT JOIN prices p ON w.ts >= p.price_ts)"""
DEADLINE = instant_us("2024-01-29")


def prices(spark, folder) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = table(spark, folder, "events").select(F.call_function("div", at, F.lit(_HOUR)).alias("h")).distinct().where("h % 4 <> 1")
    price = F.when(F.col("h") % 6 == 0, 0.18).when(F.col("h") % 6 == 3, 0.135).otherwise(0.09)
    return hours.select(F.timestamp_micros(F.col("h") * _HOUR).alias("price_ts"), price.alias("price"))


def writes(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "purchase", "payments").when(kind == "signup", "users").when(kind == "click", "Analytics_Events")
        .when(kind == "view", "page_views").otherwise(F.concat(F.lit("unknown_"), (F.col("user_id") % 3).cast("string")))
    )
    size = (F.lit(1000) + F.round(F.col("value") * 100)).cast("bigint")
    return table(spark, folder, "events").select("event_id", "ts", name.alias("table_name"), size.alias("bytes"))


def routed(spark, folder) -> DataFrame:
    return pricing.route_writes(writes(spark, folder), prices(spark, folder), deadline_us=DEADLINE)


@check("prj13_write_class", f"WITH {WRITES_SQL} SELECT table_name, {_CLASS_SQL} AS write_class, count(*) AS n_rows FROM writes GROUP BY 1, 2")
def write_class(spark, folder) -> DataFrame:
    rows = writes(spark, folder)
    return rows.groupBy("table_name", pricing.write_class(F.col("table_name")).alias("write_class")).agg(F.count(F.lit(1)).alias("n_rows"))


@check("prj16_route_writes", f"WITH {ROUTED_SQL} SELECT event_id, table_name, price, write_class, decision FROM routed")
def route_writes(spark, folder) -> DataFrame:
    return routed(spark, folder).select("event_id", "table_name", "price", "write_class", "decision")


@check(
    "joi6_price_in_force",
    f"WITH {PRICES_SQL}, {WRITES_SQL} SELECT w.event_id, p.price FROM writes w ASOF LEFT JOIN prices p ON w.ts >= p.price_ts",
)
def price_in_force(spark, folder) -> DataFrame:
    """The distributed path: series and log merged and carried forward range by range."""
    return asof_join(writes(spark, folder), prices(spark, folder), "ts", "price_ts", ["price"], broadcast_rows=0).select("event_id", "price")


@check(
    "joi6_price_lookup",
    f"WITH {PRICES_SQL}, {WRITES_SQL} SELECT w.event_id, p.price FROM writes w ASOF LEFT JOIN prices p ON w.ts <= p.price_ts",
)
def next_price(spark, folder) -> DataFrame:
    """The lookup path for a short series, here for the next price instead of the last."""
    return asof_join(writes(spark, folder), prices(spark, folder), "ts", "price_ts", ["price"], "forward").select("event_id", "price")


@check(
    "win11_running_cost",
    f"""WITH {ROUTED_SQL}, c AS (SELECT event_id, sum(CAST(bytes AS DECIMAL(18,0)) * CAST(price AS DECIMAL(12,6))) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS u FROM routed)
        SELECT event_id, round(CAST(u AS DOUBLE) / 1e9, 9) AS cost_so_far_usd, CAST(u AS DOUBLE) / 1e9 > 0.002::DOUBLE * 1.5 AS over_budget FROM c""",
)
def running_cost(spark, folder) -> DataFrame:
    return pricing.running_cost(routed(spark, folder), ["ts", "event_id"], 0.002).select("event_id", "cost_so_far_usd", "over_budget")


@check(
    "win11_first_overrun",
    f"""WITH {ROUTED_SQL}, c AS (SELECT ts, CAST(sum(CAST(bytes AS DECIMAL(18,0)) * CAST(price AS DECIMAL(12,6))) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e9 AS cost FROM routed)
        SELECT epoch_us(min(ts)) AS first_overrun_us, count(*) AS writes_over_budget FROM c WHERE cost > 0.002::DOUBLE * 1.5""",
)
def first_overrun(spark, folder) -> DataFrame:
    found = pricing.first_overrun(pricing.running_cost(routed(spark, folder), ["ts", "event_id"], 0.002), "ts")
    return found.select(F.unix_micros(F.col("first_overrun_at").cast("timestamp")).alias("first_overrun_us"), "writes_over_budget")


@check(
    "win12_price_baseline",
    f"""WITH {PRICES_SQL}, b AS (SELECT us, price, avg(price) OVER (ORDER BY us RANGE BETWEEN {7 * 86_400_000_000} PRECEDING AND CURRENT ROW) AS m FROM prices)
        SELECT us, price, round(m, 6) AS baseline, price / greatest(m, 0.001::DOUBLE) >= 1.4 AS spike FROM b""",
)
def price_baseline(spark, folder) -> DataFrame:
    found = pricing.price_baselines(prices(spark, folder), "price_ts", "price", days=7, multiplier=1.4)
    return found.select(F.unix_micros("price_ts").alias("us"), "price", F.round("baseline", 6).alias("baseline"), "spike")


DRAIN_SQL = f"""{ROUTED_SQL}, waiting AS (SELECT event_id, ts, bytes, price, epoch_us(ts) AS us FROM routed WHERE decision = 'buffer_to_wal'),
    h AS (SELECT w.*, p.price AS half_price FROM waiting w ASOF LEFT JOIN prices p ON w.us + 3600000000 >= p.us),
    nx AS (SELECT h.*, n.us AS next_us FROM h ASOF LEFT JOIN (SELECT * FROM prices WHERE price / 0.09::DOUBLE < 1.5) n ON h.us + 3600000000 <= n.us),
    f AS (SELECT *, CASE WHEN coalesce(half_price, 0.09::DOUBLE) / 0.09::DOUBLE < 1.5 THEN us + 3600000000
                         ELSE least(us + 7200000000, coalesce(next_us, us + 7200000000)) END AS flush_us FROM nx),
    drained AS (SELECT f.*, coalesce(p.price, 0.09::DOUBLE) AS flush_price FROM f ASOF LEFT JOIN prices p ON f.flush_us >= p.us)"""


@check(
    "win14_drain_schedule",
    f"""WITH {DRAIN_SQL} SELECT event_id, flush_us, flush_price, CASE WHEN flush_us >= us + 7200000000 THEN 'max_age' ELSE 'price_normal' END AS flush_reason FROM drained""",
)
def drain_schedule(spark, folder) -> DataFrame:
    waiting = routed(spark, folder).where("decision = 'buffer_to_wal'").select("event_id", "bytes", F.col("ts").alias("buffered_at"))
    found = pricing.drain_schedule(waiting, prices(spark, folder))
    return found.select("event_id", F.unix_micros("flush_at").alias("flush_us"), "flush_price", "flush_reason")


_METER_SQL = """SELECT CAST(sum(bytes) FILTER (decision <> 'buffer_to_wal') AS BIGINT) AS bytes_transferred,
    round(CAST(sum(CAST(bytes AS DECIMAL(18,0)) * CAST(price AS DECIMAL(12,6))) FILTER (decision <> 'buffer_to_wal') AS DOUBLE) / 1e9, 9) AS cost_usd,
    round(CAST(sum(bytes) FILTER (decision <> 'buffer_to_wal') AS DOUBLE) / 720 * 240 / 1e9 * 0.18::DOUBLE, 6) AS projected_total_usd,
    2.0::DOUBLE AS spike_multiplier, TRUE AS is_spike"""
_BUFFER_SQL = """count(*) FILTER (decision = 'buffer_to_wal') AS buffer_size,
    round((epoch_us(TIMESTAMP '2024-01-31') - min(epoch_us(ts)) FILTER (decision = 'buffer_to_wal')) / 3600000000, 3) AS oldest_age_hours,
    round(CAST(sum(CAST(bytes AS DECIMAL(18,0)) * (CAST(price AS DECIMAL(12,6)) - 0.09)) FILTER (decision = 'buffer_to_wal') AS DOUBLE) / 1e9, 9) AS savings_usd"""
_NOW = instant_us("2024-01-31")


@check("agg22_egress_meter", f"WITH {ROUTED_SQL} {_METER_SQL} FROM routed")
def egress_meter(spark, folder) -> DataFrame:
    return pricing.egress_meter(routed(spark, folder), 720, 0.18)


@check("agg23_buffer_status", f"WITH {ROUTED_SQL} SELECT {_BUFFER_SQL} FROM routed")
def buffer_status(spark, folder) -> DataFrame:
    return pricing.buffer_status(routed(spark, folder), _NOW)


@check(
    "rpt4_cost_status",
    f"WITH {ROUTED_SQL} {_METER_SQL}, {_BUFFER_SQL}, FALSE AS cost_optimization_active, TRUE AS deadline_override_active FROM routed",
)
def cost_status(spark, folder) -> DataFrame:
    rows = routed(spark, folder)
    return pricing.cost_status(
        pricing.egress_meter(rows, 720, 0.18), pricing.buffer_status(rows, _NOW), _NOW, DEADLINE
    )


@check(
    "agg32_recalibration",
    """WITH o AS (SELECT user_id AS migration_id, round(avg(sqrt(value)), 6) AS new_mean_gbps, round(stddev_pop(sqrt(value)), 6) AS new_std_gbps,
                  count(*) AS n, max(value) * 20 AS estimate_usd, max(value) * 20 * (1 + (user_id % 30) / 100.0::DOUBLE) AS observed_usd FROM events GROUP BY user_id),
            d AS (SELECT *, CASE WHEN migration_id % 5 = 0 THEN 0.0::DOUBLE ELSE abs(observed_usd - estimate_usd) / greatest(estimate_usd, 0.01::DOUBLE) * 100 END AS pct FROM o)
       SELECT migration_id, 1.0::DOUBLE AS old_mean_gbps, new_mean_gbps, 0.1::DOUBLE AS old_std_gbps, new_std_gbps, round(pct, 2) AS p50_deviation_pct,
              round(pct, 6) <= 10 AS calibration_passed FROM d""",
)
def recalibration(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events")
    user = F.col("user_id")
    observed = rows.select(user.alias("migration_id"), F.sqrt("value").alias("gbps"))
    ids = rows.groupBy(user.alias("migration_id")).agg((F.max("value") * 20).alias("estimate_usd"))
    key = F.col("migration_id")
    actual = F.col("estimate_usd") * (F.lit(1) + (key % 30) / F.lit(100.0))
    costs = ids.select(key, "estimate_usd", F.when(key % 5 != 0, actual).alias("observed_usd"))
    old = ids.select(key, F.lit(1.0).alias("mean_gbps"), F.lit(0.1).alias("std_gbps"))
    found = risk.recalibrate(observed, old, costs)
    return found
