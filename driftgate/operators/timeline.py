"""Rules over metric series: sustained limits, throttling, recovery, worst windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import HOUR_US, epoch_us
from driftgate.operators.asof import nearest_by_key
from driftgate.operators.prefix import running_scan


def trailing_window(
    df: DataFrame, ts: str, width_us: int, measures: dict[str, Callable], keys: Sequence[str] = ()
) -> DataFrame:
    """Measures over the rows of the last ``width_us`` microseconds, current row included.

    ``measures`` maps a name to a function of the window. Time is cut into blocks
    of the window's width; a row is sent to its own block and, as context, to the
    next. So one busy series is still many small windows.
    """
    at = epoch_us(ts)
    block = F.call_function("div", at - F.pmod(at, F.lit(width_us)), F.lit(width_us))
    places = F.array(
        F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own"))
    )
    placed = df.withColumn("_place", F.explode(places)).withColumn("_block", F.col("_place.b"))
    frame = Window.partitionBy(*keys, "_block").orderBy(epoch_us(ts)).rangeBetween(-width_us, Window.currentRow)
    measured = placed.select("*", *[make(frame).alias(name) for name, make in measures.items()])
    return measured.where("_place.own").drop("_place", "_block")


def compare_to(value: Column, op: str, limit: Column) -> Column:
    return {
        "<=": value <= limit, "<": value < limit, ">=": value >= limit, ">": value > limit, "=": value == limit,
    }[op]


def sustained(metrics: DataFrame, ts: str, value: str, op: str, limit: float, hours: float, keys: Sequence[str] = ()) -> DataFrame:
    """Whether the limit has held for the whole trailing window at each sample.

    It has when no sample in the window breaks it and the samples span the window.
    """
    width = int(hours * HOUR_US)
    broken = F.when(compare_to(F.col(value), op, F.lit(limit)), 0).otherwise(1)
    checked = trailing_window(
        metrics.withColumn("_broken", broken), ts, width,
        {"_breaks": lambda w: F.max("_broken").over(w), "_since": lambda w: F.min(epoch_us(ts)).over(w)}, keys,
    )
    held = (F.col("_breaks") == 0) & (epoch_us(ts) - F.col("_since") >= width)
    return checked.withColumn("sustained", held).drop("_broken", "_breaks", "_since")


def throttle(
    metrics: DataFrame, order: Sequence[str], lag: str = "lag_seconds", keys: Sequence[str] = (),
    limit: float = V.THROTTLE_LAG_SECONDS, full: int = V.FULL_MULTIPLIER, slow: int = V.THROTTLED_MULTIPLIER,
) -> DataFrame:
    """Replay multiplier with hysteresis: slow above the limit, full again below half of it."""
    signal = F.when(F.col(lag) > limit, slow).when(F.col(lag) < limit / 2, full)
    scanned = running_scan(metrics, order, {"_before": ("last", signal)}, keys=keys, inclusive=False)
    before = F.coalesce(F.col("_before"), F.lit(full))
    now = F.coalesce(signal, before)
    return scanned.select(
        *metrics.columns, now.cast("int").alias("multiplier"), ((now == slow) & (before == full)).alias("throttle_event")
    )


def worst_window(metrics: DataFrame, ts: str, value: str, width: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Worst value of each tumbling window."""
    return metrics.groupBy(*keys, F.window(ts, width).alias("window")).agg(F.max(value).alias("worst"))


def peak_snapshot(metrics: DataFrame, ts: str, first_p95: float, keys: Sequence[str] = ()) -> DataFrame:
    """Peaks and last figures of a replay, as inputs of its benchmarks."""
    last = {name: F.max_by(name, ts) for name in ("p99_insert_latency_ms", "p99_select_latency_ms", "lease_renewal_success_rate_pct", "risk_p95_usd")}
    found = metrics.groupBy(*keys).agg(
        F.max("lag_seconds").alias("peak_consumer_lag_seconds"), F.max("divergence_pct").alias("max_merkle_divergence_pct"),
        *[column.alias(name) for name, column in last.items()],
    )
    drift = F.abs((F.col("risk_p95_usd") - first_p95) / F.lit(first_p95) * 100) if first_p95 > 0 else F.lit(0.0)
    return found.withColumn("risk_stability_pct", drift).drop("risk_p95_usd")


def as_long(wide: DataFrame, entity: str, names: Sequence[str]) -> DataFrame:
    """Wide metrics as (entity, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(F.col(entity).alias("entity"), F.explode(pairs).alias("_m")).select("entity", "_m.*")


def time_to_recovery(
    faults: DataFrame, metrics: DataFrame, fault_id: str, cleared_at: str, ts: str, key: str,
    window_seconds: float, lag_limit: float = 30.0, divergence_limit: float = 0.001,
) -> DataFrame:
    """First healthy sample after each fault clears, inside its recovery window."""
    healthy = metrics.where((F.col("lag_seconds") < lag_limit) & (F.col("divergence_pct") <= divergence_limit))
    found = nearest_by_key(faults, healthy, key, epoch_us(cleared_at), epoch_us(ts), F.lit(0), "_next", "forward")
    waited = F.col("_next.at") - epoch_us(cleared_at)
    waited = F.when(waited <= int(window_seconds * 1e6), waited)
    return found.select(*faults.columns, F.round(waited / 1e6, 3).alias("recovery_seconds"), waited.isNotNull().alias("recovered"))


def lag_shift(
    changes: DataFrame, metrics: DataFrame, change_id: str, changed_at: str, ts: str, key: str,
    before_seconds: float, after_seconds: float, limit: float = 30.0,
) -> DataFrame:
    """Last lag before and after a change, and whether it moved by less than ``limit``."""
    at, until = epoch_us(changed_at), epoch_us(changed_at) + int(after_seconds * 1e6)
    found = nearest_by_key(changes, metrics, key, at, epoch_us(ts), F.col("lag_seconds"), "_earlier")
    found = nearest_by_key(found, metrics, key, until, epoch_us(ts), F.col("lag_seconds"), "_later")
    before = F.when(F.col("_earlier.at") >= at - int(before_seconds * 1e6), F.col("_earlier.value"))
    after = F.when(F.col("_later.at") > at, F.col("_later.value"))
    delta = F.abs(after - before)
    return found.select(
        *changes.columns, before.alias("lag_before"), after.alias("lag_after"), F.round(delta, 6).alias("lag_delta"),
        F.coalesce(delta < limit, F.lit(False)).alias("stable"),
    )
