"""Rollback-cost simulation and the verdicts drawn from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.hashing import normal_draw, normal_draws
from driftgate.functions.risk_rules import (
    deviation_pct, network_health, progress_pct, risk_band, rollback_feasible, seconds_to_limit,
)
from driftgate.operators.prefix import running_scan

_BLOCK = 1_000
_INPUTS = ("bytes_done", "write_rate", "lag_seconds", "merkle_seconds", "std_gbps")


def draws(states: DataFrame, n: int, state: str = "state_id", together: bool = False) -> DataFrame:
    """Every state with draws 0..n-1 in ``draw``, spread evenly over the cluster.

    States multiply inside the row (no join): first into blocks, which are
    distributed, then each block into its draws. One state may have any number.
    ``together`` leaves the blocks of a state in one task, for what sorts a state's draws anyway.
    """
    dealt = _together(states, state) if together else states
    blocks = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _BLOCK))))
    # A given number of partitions: blocks are a few bytes each, and adaptive
    # execution would otherwise merge them into one task that makes every draw.
    tasks = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks if together else blocks.repartition(tasks, F.col(state), F.col("_block"))
    first = F.col("_block").cast("bigint") * _BLOCK
    last = F.least(first + F.lit(_BLOCK - 1), F.lit(n - 1).cast("bigint"))
    return blocks.withColumn("draw", F.explode(F.sequence(first, last))).drop("_block")


def rollback_cost(z: Column, unit_fix: bool = False) -> Column:
    """Cost of one draw from a state's columns and a standard normal ``z``.

    Egress already paid, re-sync of diverged bytes, downtime and repair. The
    rate divides gigabytes and counts as hours; ``unit_fix`` treats it as the
    gigabits per second its name says.
    """
    return _cost(F.greatest(_rate(F.col("std_gbps"), z), F.lit(V.ROLLBACK_FLOOR_GBPS)), F.col, unit_fix)


def _rate(std, z):
    return V.ROLLBACK_GBPS + std * 0.5 * z


def _cost(rate, of, unit_fix: bool):
    """The arithmetic of a cost, for columns as for numpy arrays; ``of`` gives a state's value by name."""
    per_hour = rate * (3600.0 / 8.0) if unit_fix else rate
    egress = of("bytes_done") / V.BYTES_PER_GB * V.EGRESS_PER_GB
    resync_hours = (of("lag_seconds") * of("write_rate")) / V.BYTES_PER_GB / per_hour
    repair_hours = (of("merkle_seconds") * of("write_rate") * V.DIRTY_SHARE) / V.BYTES_PER_GB / per_hour
    downtime_hours = V.BASE_DOWNTIME_SECONDS / 3600.0 + resync_hours
    return egress + (resync_hours + downtime_hours + repair_hours) * V.DOWNTIME_PER_HOUR


def simulate_cost(
    states: DataFrame, n: int = V.SIMULATIONS, seed: int = 0, state: str = "state_id", unit_fix: bool = False,
    method: str = "xxhash64", together: bool = False,
) -> DataFrame:
    """One row per state and draw with its cost.

    Draws depend on state, number and seed alone, so results repeat on any
    cluster; with ``method="md5"`` on any engine. States need bytes_done, write_rate, lag_seconds, merkle_seconds and
    std_gbps.
    """
    drawn = draws(states, n, state, together)
    key = F.concat_ws(":", F.col(state).cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))
    return drawn.withColumn("cost", rollback_cost(normal_draw(key, method), unit_fix))


def _summed_rows(states: DataFrame, n: int, seed: int, state: str, unit_fix: bool, method: str, points: list[float]) -> DataFrame:
    """Percentiles, mean and deviation of each state's costs. A state's draws are made and sorted in one task: no draw is shuffled."""
    costs = simulate_cost(states, n, seed, state, unit_fix, method, together=True).select(state, "cost")
    held = costs.groupBy(state).agg(
        F.sort_array(F.collect_list("cost")).alias("_c"), F.avg("cost").alias("_mean"), F.stddev_pop("cost").alias("_std")
    )

    def at(point: float) -> Column:
        rank = F.lit(point) * (F.size("_c") - 1)
        low, high = F.get("_c", F.floor(rank).cast("int")), F.get("_c", F.ceil(rank).cast("int"))
        return F.when(F.floor(rank) == F.ceil(rank), low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)

    return held.select(state, F.when(F.size("_c") > 0, F.array(*[at(p) for p in points])).alias("_p"), "_mean", "_std")


def _summed_arrays(states: DataFrame, n: int, seed: int, state: str, unit_fix: bool, method: str, points: list[float]) -> DataFrame:
    """The same for MD5 draws, which Spark's own functions make ten times more slowly: a state's costs are one array of numbers."""
    kind = states.schema[state].dataType.simpleString()
    text = states.where(F.col(state).isNotNull()).select(
        state, F.col(state).cast("string").alias("_text"), *[F.col(c).cast("double").alias(c) for c in _INPUTS]
    )

    def summed(rows: pa.Table) -> pa.Table:
        costs = [_costs(row, n, seed, unit_fix) for row in rows.to_pylist()]
        c = np.sort(np.concatenate([x for x in costs if x is not None] or [np.empty(0)]))  # not a number comes last, as in Spark
        found, mean, std = None, None, None
        if len(c):
            rank = np.array(points) * (len(c) - 1)
            low, high = np.floor(rank).astype(int), np.ceil(rank).astype(int)
            found = np.where(low == high, c[low], (high - rank) * c[low] + (rank - low) * c[high]).tolist()
            mean, std = float(c.mean()), float(c.std())
        given = {
            state: rows[state].slice(0, 1).combine_chunks(), "_p": pa.array([found], pa.list_(pa.float64())),
            "_mean": pa.array([mean], pa.float64()), "_std": pa.array([std], pa.float64()),
        }
        return pa.table(given)

    return _together(text, state).groupBy(state).applyInArrow(summed, f"`{state}` {kind}, _p array<double>, _mean double, _std double")


def _costs(row: dict, n: int, seed: int, unit_fix: bool) -> np.ndarray | None:
    """Costs of all draws of one state, or none where an input is null; without a deviation the rate is the least."""
    if any(row[c] is None for c in _INPUTS if c != "std_gbps"):
        return None
    out, values = np.empty(n), {c: np.float64(row[c]) for c in _INPUTS if row[c] is not None}
    with np.errstate(all="ignore"):
        for first in range(0, n, 10 * _BLOCK):
            last = min(n, first + 10 * _BLOCK)
            rate = np.full(last - first, V.ROLLBACK_FLOOR_GBPS)
            if "std_gbps" in values:
                z = normal_draws(f"{row['_text']}:", first, last, f":{seed}")
                rate = np.maximum(_rate(values["std_gbps"], z), V.ROLLBACK_FLOOR_GBPS)
            out[first:last] = _cost(rate, values.__getitem__, unit_fix)
    return out


def _together(states: DataFrame, state: str) -> DataFrame:
    """All rows of a state in one task; a given number of tasks, for the reason in ``draws``.

    An odd number, since Spark drops a repartition that equals the shuffle below it, whose few bytes it then reads in one task.
    """
    return states.repartition(2 * int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, F.col(state))


def evaluate_risk(
    states: DataFrame,
    n: int = V.SIMULATIONS,
    seed: int = 0,
    sla: float = V.SLA_USD,
    state: str = "state_id",
    unit_fix: bool = False,
    stop_when_done: bool = True,
    method: str = "xxhash64",
    percentiles: str = "exact",
) -> DataFrame:
    """Cost distribution and verdict per state.

    ``percentiles`` is "exact" (interpolated; every draw of a state is held) or
    "sketch" (bounded, for very many draws), whatever the number of draws. ``stop_when_done`` gives no horizon once all bytes are moved.
    """
    points = [0.05, 0.5, 0.95, 0.99]
    needed = states.select(state, *_INPUTS)
    if percentiles == "sketch":
        costs = simulate_cost(needed, n, seed, state, unit_fix, method).groupBy(state).agg(
            F.percentile_approx("cost", points, 10_000).alias("_p"), F.avg("cost").alias("_mean"), F.stddev_pop("cost").alias("_std")
        )
    elif percentiles == "exact":
        costs = (_summed_arrays if method == "md5" else _summed_rows)(needed, n, seed, state, unit_fix, method, points)
    else:
        raise ValueError(percentiles)
    p95 = F.col("_p")[2]
    left = F.col("total_bytes") - F.col("bytes_done") if stop_when_done else None
    return states.join(costs, state).select(
        *states.columns,
        *[F.round(F.col("_p")[i], 2).alias(name) for i, name in enumerate(("p5_usd", "p50_usd", "p95_usd", "p99_usd"))],
        F.round("_mean", 2).alias("mean_usd"), F.round("_std", 2).alias("std_usd"),
        rollback_feasible(p95, sla).alias("rollback_feasible"),
        seconds_to_limit(p95, F.col("mean_gbps"), left, sla).alias("event_horizon_seconds"),
        F.round(progress_pct(F.col("bytes_done"), F.col("total_bytes")), 2).alias("progress_pct"),
        risk_band(p95, sla).alias("recommendation"),
        F.round(network_health(F.col("mean_gbps"), F.col("std_gbps")), 3).alias("network_health"),
    )


def checkpoint_states(runs: DataFrame, checkpoints: list[float] | None = None, run: str = "run_id") -> DataFrame:
    """States of a planned run at its progress checkpoints.

    ``runs`` has total_bytes, write_rate, mean_gbps and std_gbps.
    """
    shares = F.array(*[F.lit(c) for c in (checkpoints or V.PROGRESS_CHECKPOINTS)])
    spread = runs.withColumn("progress", F.explode(shares))
    return spread.select(
        F.concat_ws("@", F.col(run).cast("string"), F.round(F.col("progress") * 100, 0).cast("int").cast("string")).alias("state_id"),
        *runs.columns, "progress",
        F.floor(F.col("total_bytes") * F.col("progress")).cast("bigint").alias("bytes_done"),
        F.least(F.col("progress") * 30, F.lit(120.0)).alias("lag_seconds"), F.lit(300.0).alias("merkle_seconds"),
    )


def pre_migration_estimate(
    runs: DataFrame, n: int = V.SIMULATIONS, seed: int = 0, sla: float = V.SLA_USD, method: str = "xxhash64"
) -> DataFrame:
    """Risk curve of a planned run over its progress."""
    return evaluate_risk(checkpoint_states(runs), n, seed, sla, method=method)


def band_transitions(evaluations: DataFrame, order: list[str], run: str = "run_id", band: str = "recommendation") -> DataFrame:
    """Evaluations at which the band changes in a way worth an alert.

    Entering BLOCK, going from PROCEED to CAUTION, and coming back to PROCEED;
    before the first evaluation a run counts as PROCEED.
    """
    seen = running_scan(evaluations, order, {"_last": ("last", F.col(band))}, keys=[run], inclusive=False)
    before = F.coalesce(F.col("_last"), F.lit("PROCEED"))
    now = F.col(band)
    alert = (
        F.when((now == "BLOCK") & (before != "BLOCK"), "on_block")
        .when((now == "CAUTION") & (before == "PROCEED"), "on_caution")
        .when((now == "PROCEED") & before.isin("BLOCK", "CAUTION"), "on_proceed")
    )
    return seen.withColumn("previous", before).withColumn("alert", alert).drop("_last").where("alert is not null")


def recalibrate(observed: DataFrame, old: DataFrame, costs: DataFrame, key: str = "migration_id", limit_pct: float = 10.0) -> DataFrame:
    """Old and observed network figures, and whether the cost estimate was close.

    ``observed`` holds throughput samples, ``old`` the former mean and deviation,
    ``costs`` the estimate and the actual cost (either may be missing).
    """
    fresh = observed.groupBy(key).agg(
        F.round(F.avg("gbps"), 6).alias("new_mean_gbps"), F.round(F.stddev_pop("gbps"), 6).alias("new_std_gbps")
    )
    estimate, actual = F.col("estimate_usd"), F.col("observed_usd")
    known = F.coalesce(estimate, F.lit(0.0)) * F.coalesce(actual, F.lit(0.0)) != 0
    pct = F.when(known, deviation_pct(actual, estimate)).otherwise(F.lit(0.0))
    return fresh.join(old, key, "left").join(costs, key, "left").select(
        key, F.col("mean_gbps").alias("old_mean_gbps"), "new_mean_gbps", F.col("std_gbps").alias("old_std_gbps"),
        "new_std_gbps", F.round(pct, 2).alias("p50_deviation_pct"), (pct <= limit_pct).alias("calibration_passed"),
    )
