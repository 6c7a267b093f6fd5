"""Windowed metrics on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.operators.risk import evaluate_risk


def tumbling(
    stream: DataFrame, ts: str, width: str, measures: dict[str, Column], keys: Sequence[str] = (), lateness: str = "1 minute"
) -> DataFrame:
    """Measures per tumbling window, such as the 10-second heartbeat grid or 10-minute divergence."""
    grouped = stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width).alias("window"))
    return grouped.agg(*[column.alias(name) for name, column in measures.items()]).select(
        *keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *measures
    )


def dead_man_stream(
    gains: DataFrame, ts: str, gained: str, keys: Sequence[str] = (), hours: int = V.DEADMAN_HOURS,
    every: str = "30 minutes", min_bytes: float | None = None, lateness: str = "10 minutes",
) -> DataFrame:
    """Bytes gained per sliding window and whether that is too little.

    ``gains`` has the bytes moved by each finished chunk; a sum, so the window
    needs no memory of single chunks. A window without any chunk makes no row:
    feed a zero per run and interval.
    """
    needed = V.DEADMAN_BYTES_PER_HOUR * hours if min_bytes is None else min_bytes
    summed = (
        gains.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, f"{hours} hours", every).alias("window"))
        .agg(F.sum(gained).alias("gained_bytes"), F.count(F.lit(1)).alias("checkpoints"))
    )
    alert = (F.col("checkpoints") >= 2) & (F.col("gained_bytes") < needed)
    return summed.select(
        *keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "gained_bytes", "checkpoints", alert.alias("alert"),
    )


def lag_gauge(events: DataFrame, now_ms: Column, keys: Sequence[str] = ("topic",), alert_days: float = V.RETENTION_ALERT_DAYS) -> DataFrame:
    """Lag per topic against a given now, with the retention warning; use output mode complete or update."""
    newest = events.groupBy(*keys).agg(F.max("ts_ms").alias("newest_ts_ms"))
    lag = F.greatest(F.lit(0.0), (now_ms - F.col("newest_ts_ms")) / F.lit(1000.0))
    return newest.select(*keys, F.round(lag, 2).alias("lag_seconds"), (lag >= alert_days * 86400).alias("retention_at_risk"))


def risk_batches(write: Callable[[DataFrame, int], None], n: int = V.SIMULATIONS, seed: int = 0, sla: float = V.SLA_USD, method: str = "xxhash64") -> Callable:
    """``foreachBatch`` body that evaluates each batch of states and hands the result on."""

    def body(states: DataFrame, batch_id: int) -> None:
        write(evaluate_risk(states, n, seed, sla, stop_when_done=False, method=method), batch_id)

    return body
