"""Scalar rules of the rollback-risk estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate import fixed_values as V


def risk_band(p95: Column, sla: float = V.SLA_USD) -> Column:
    """BLOCK at or over the limit, CAUTION from 80 % of it, else PROCEED."""
    return (
        F.when(p95 >= sla, "BLOCK").when(p95 >= sla * V.CAUTION_SHARE, "CAUTION").otherwise("PROCEED")
    )


def rollback_feasible(p95: Column, sla: float = V.SLA_USD) -> Column:
    return p95 < F.lit(sla)


def network_health(mean: Column, std: Column) -> Column:
    """One minus the coefficient of variation, held to 0..1; 0 without throughput."""
    health = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.try_divide(std, mean)))
    return F.when(mean <= 0, F.lit(0.0)).otherwise(health)


def seconds_to_limit(
    p95: Column, mean_gbps: Column, bytes_left: Column | None = None, sla: float = V.SLA_USD
) -> Column:
    """Seconds until P95 reaches the limit at the present egress rate.

    0 when it is already there; null when nothing is left to move (only if
    ``bytes_left`` is given) or the rate is not positive.
    """
    rate = mean_gbps * F.lit(V.EGRESS_PER_GB)
    answer = F.when(p95 >= sla, F.lit(0.0))
    if bytes_left is not None:
        answer = answer.when(bytes_left <= 0, F.lit(None).cast("double"))
    return answer.when(rate > 0, F.round(F.try_divide(F.lit(sla) - p95, rate), 0))


def progress_pct(done: Column, total: Column) -> Column:
    return F.coalesce(F.when(total > 0, F.try_divide(done, total) * 100), F.lit(0.0)).cast("double")


def time_estimate_hours(total_bytes: Column, mean_gbps: Column, std_gbps: Column) -> Column:
    """Typical and pessimistic duration, in the estimate's own GB-per-hour units."""
    gigabytes = total_bytes / F.lit(V.BYTES_PER_GB)
    slow = F.greatest(mean_gbps - F.lit(2.0) * std_gbps, F.lit(0.001))
    return F.struct(
        F.round(gigabytes / F.greatest(mean_gbps, F.lit(0.001)), 1).alias("p50"),
        F.round(gigabytes / slow, 1).alias("p95"),
    )


def deviation_pct(actual: Column, estimate: Column) -> Column:
    """Distance from an estimate in percent; 0 without an estimate."""
    pct = F.try_divide(F.abs(actual - estimate), F.greatest(estimate, F.lit(0.01))) * 100
    return F.when(estimate > 0, pct).otherwise(F.lit(0.0))


def accuracy_band(deviation: Column) -> Column:
    answer = None
    for limit, words in V.ACCURACY_BANDS:
        if answer is None:
            answer = F.when(deviation <= limit, words)
        elif limit is None:
            answer = answer.otherwise(words)
        else:
            answer = answer.when(deviation <= limit, words)
    return answer


def deviation_factors(deviation: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(deviation > n, words) for n, words in V.DEVIATION_FACTORS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(V.NO_FACTOR)))


def day_phase(days: Column) -> Column:
    """Stage of the ten-day wind-down from whole days since cutover."""
    answer = None
    for limit, name in V.DAY_PHASES:
        if answer is None:
            answer = F.when(days < limit, name)
        elif limit is None:
            answer = answer.otherwise(name)
        else:
            answer = answer.when(days < limit, name)
    return answer


def latency_proxy(total_ms: Column, count: Column) -> Column:
    """Latency figures from a mean alone: 1x, 2x, 4x and 10x; null without calls."""
    mean = F.round(F.try_divide(F.coalesce(total_ms, F.lit(0.0)), F.greatest(count, F.lit(1))), 3)
    return F.when(
        count > 0,
        F.struct(
            mean.alias("p50_ms"),
            (mean * 2).alias("p95_ms"),
            (mean * 4).alias("p99_ms"),
            (mean * 10).alias("max_ms"),
            count.cast("bigint").alias("calls"),
        ),
    )
