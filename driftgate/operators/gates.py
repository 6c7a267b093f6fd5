"""Gates: rules over metrics, with what passed, what blocks and the roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import epoch_us
from driftgate.functions.risk_rules import day_phase
from driftgate.functions.rows import fixed_text
from driftgate.operators.prefix import running_scan
from driftgate.operators.timeline import compare_to, trailing_window
from driftgate.session import cut_lineage

Rule = tuple[str, str, str, float]


def evaluate_gate(metrics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per entity and rule: actual value, limit and whether it passed.

    ``metrics`` is (entity, metric, value) with one value per entity and metric.
    A metric an entity lacks fails its rule. One grouping, no join.
    """
    wanted = sorted({metric for _, metric, _, _ in rules})
    wide = metrics.groupBy("entity").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"_{m}") for m in wanted]
    )
    results = F.array(
        *[
            F.struct(
                F.lit(check).alias("check_id"), F.lit(metric).alias("metric"), F.col(f"_{metric}").cast("double").alias("actual"),
                F.lit(float(limit)).alias("limit"),
                F.coalesce(compare_to(F.col(f"_{metric}"), op, F.lit(limit)), F.lit(False)).alias("passed"),
            )
            for check, metric, op, limit in rules
        ]
    )
    return wide.select("entity", F.explode(results).alias("_r")).select("entity", "_r.*")


def gate_verdict(results: DataFrame) -> DataFrame:
    """Per entity: all passed, how many failed, which block."""
    return results.groupBy("entity").agg(
        F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check_id")))), ",").alias("blocking"),
    )


def preflight(metrics: DataFrame, signoffs: DataFrame, rules: Sequence[Rule] = tuple(V.PREFLIGHT_RULES), manual: Sequence[str] = tuple(V.PREFLIGHT_MANUAL)) -> DataFrame:
    """Automated items are green or red, manual ones green once signed off (entity, check_id)."""
    automated = evaluate_gate(metrics, rules).select(
        "entity", "check_id", F.lit(True).alias("automated"), F.when(F.col("passed"), "green").otherwise("red").alias("status")
    )
    items = F.explode(F.array(*[F.lit(m) for m in manual])).alias("check_id")
    signed = signoffs.select("entity", "check_id").distinct().withColumn("_signed", F.lit(True))
    asked = metrics.select("entity").distinct().select("entity", items).join(signed, ["entity", "check_id"], "left")
    by_hand = asked.select(
        "entity", "check_id", F.lit(False).alias("automated"),
        F.when(F.col("_signed").isNotNull(), "green").otherwise("manual").alias("status"),
    )
    return automated.unionByName(by_hand)


def sustained_metrics(
    samples: DataFrame, ts: str, at: Column, rules: Sequence[Rule] = tuple(V.PREFLIGHT_RULES),
    names: Sequence[str] = ("replication_lag_seconds", "anomaly_score"), hours: float = V.PREFLIGHT_SUSTAINED_HOURS,
) -> DataFrame:
    """Metrics for ``preflight`` from samples (entity, metric, value, ts): the value that speaks for the whole time before ``at``.

    A metric among ``names`` has to keep its limit for ``hours``: its worst value of that time counts, and none at all
    if its samples do not reach that far back, so its item fails. Of other metrics the last value counts.
    """
    start = at - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    seen = samples.where(F.col(ts) <= at)
    found = seen.groupBy("entity", "metric").agg(
        F.min(ts).alias("_since"), F.max_by("value", ts).alias("_last"),
        F.max(F.when(F.col(ts) >= start, F.col("value"))).alias("_most"), F.min(F.when(F.col(ts) >= start, F.col("value"))).alias("_least"),
    )
    highest = [metric for _, metric, op, _ in rules if op in ("<=", "<") and metric in names]
    lowest = [metric for _, metric, op, _ in rules if op in (">=", ">") and metric in names]
    metric = F.col("metric")
    worst = F.when(metric.isin(highest), F.col("_most")).when(metric.isin(lowest), F.col("_least"))
    value = F.when(~metric.isin([*highest, *lowest]), F.col("_last")).when(F.col("_since") <= start, worst)
    return found.select("entity", "metric", value.alias("value"))


def preflight_verdict(items: DataFrame) -> DataFrame:
    """Only red automated items block; unsigned manual ones are pending."""
    red = F.col("automated") & (F.col("status") == "red")
    pending = F.col("status") == "manual"

    def listed(which: Column, name: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(which, F.col("check_id")))), ",").alias(name)

    return items.groupBy("entity").agg(
        ((F.count_if(red) == 0) & (F.count_if(pending) == 0)).alias("all_green"),
        listed(red, "blocking_items"), listed(pending, "manual_items_pending"),
    )


def post_cutover_report(checkpoints: DataFrame, merkle_checks: DataFrame, spot_checks: DataFrame) -> DataFrame:
    """Verdict over checkpoints (phase, passed), hash-tree checks (divergence_pct) and spot checks (passed).

    A phase without checkpoints has not passed.
    """
    def phase(name: str) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col("phase") == name, F.col("passed"))), F.lit(False))

    k = F.lit(1).alias("_k")
    points = checkpoints.agg(
        phase("immediate").alias("immediate_window_passed"), phase("extended").alias("extended_window_passed"),
        F.count(F.lit(1)).alias("total_checkpoints"), F.count_if(~F.col("passed")).alias("failed_checkpoints"),
    ).select("*", k)
    trees = merkle_checks.agg(
        F.count(F.lit(1)).alias("merkle_verifications"),
        F.coalesce(F.bool_and(F.col("divergence_pct") <= 0), F.lit(True)).alias("merkle_all_clean"),
    ).select("*", k)
    spots = spot_checks.agg(
        F.count(F.lit(1)).alias("spot_checks_run"), F.count_if("passed").alias("spot_checks_passed")
    ).select("*", k)
    safe = F.col("immediate_window_passed") & F.col("extended_window_passed") & F.col("merkle_all_clean")
    return points.join(trees, "_k").join(spots, "_k").drop("_k").withColumn("edge_decommission_safe", safe)


def resilience_score(benchmarks: DataFrame, experiments: DataFrame, inputs: DataFrame, run: str = "run_id") -> DataFrame:
    """Score out of 100 per run.

    ``benchmarks`` (run, name, passed), ``experiments`` (run, name, state),
    ``inputs`` (run, deviation_pct, anomaly_ok). Halves round to even.
    """
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.concat(F.lit("Benchmark FAILED: "), F.col("name")))))
    b = benchmarks.groupBy(run).agg(F.count_if("passed").alias("_b"), failed.alias("_bf"))
    bad = ~F.col("state").isin("passed", "skipped")
    lost = F.sort_array(
        F.collect_list(F.when(bad, F.concat(F.lit("Experiment FAILED: "), F.col("name"), F.lit(" (state="), F.col("state"), F.lit(")"))))
    )
    e = experiments.groupBy(run).agg(F.count_if(F.col("state") == "passed").alias("_e"), lost.alias("_ef"))
    joined = inputs.join(b, run, "left").join(e, run, "left")
    drift = F.col("deviation_pct")
    points = {
        "benchmark_score": F.coalesce("_b", F.lit(0)) * F.lit(V.BENCHMARK_POINTS / V.BENCHMARK_COUNT),
        "experiment_score": F.coalesce("_e", F.lit(0)) * F.lit(V.EXPERIMENT_POINTS / V.EXPERIMENT_COUNT),
        "stability_score": F.when(drift <= 20, V.STABILITY_POINTS).when(drift <= 40, V.STABILITY_POINTS * 0.5).otherwise(0.0),
        "anomaly_score": F.when(F.col("anomaly_ok"), V.ANOMALY_POINTS).otherwise(0.0),
    }
    total = F.lit(0.0)
    for part in points.values():
        total = total + part
    empty = F.array().cast("array<string>")
    notes = F.array_compact(
        F.array(
            F.when(~F.col("anomaly_ok"), "Anomaly detector failed calibration check"),
            F.when(drift > 40, F.concat(F.lit("Risk model drift too high: "), fixed_text(drift, 1), F.lit("% > 40%"))),
        )
    )
    return joined.select(
        run, F.bround(total, 0).cast("int").alias("score"), (F.bround(total, 0) >= V.SCORE_PASS).alias("passed"),
        *[F.round(part, 2).alias(name) for name, part in points.items()],
        F.array_join(F.concat(F.coalesce("_bf", empty), F.coalesce("_ef", empty), notes), "; ").alias("blocking_failures"),
    )


def experiment_states(criteria: DataFrame, recoveries: DataFrame, key: str = "experiment") -> DataFrame:
    """passed when recovery is verified and every criterion holds, else failed."""
    held = criteria.groupBy(key).agg(F.bool_and("passed").alias("_all"))
    ok = F.coalesce("_all", F.lit(True)) & F.coalesce("recovery_verified", F.lit(False))
    return recoveries.join(held, key, "left").select(key, F.when(ok, "passed").otherwise("failed").alias("state"))


def retention_rules(settings: DataFrame) -> DataFrame:
    """Retention per resource from (resource, key, value): at least seven days or unlimited."""
    value = F.col("value").try_cast("bigint")
    kept = settings.where("key = 'retention.ms'")
    ok = (value == -1) | (value >= V.RETENTION_7_DAYS_MS)
    return kept.select("resource", value.alias("retention_ms"), F.coalesce(ok, F.lit(False)).alias("passed"))


def source_log_rules(settings: DataFrame) -> DataFrame:
    """Log settings per resource; a setting that is missing fails."""
    wanted = [*V.SOURCE_LOG_SETTINGS]
    names = [n for n, _ in wanted] + ["expire_logs_days"]
    wide = settings.groupBy("resource").agg(*[F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in names])
    checks = [
        F.struct(F.lit(n).alias("setting"), F.coalesce(F.upper(n) == expected, F.lit(False)).alias("passed")) for n, expected in wanted
    ]
    days = F.col("expire_logs_days").try_cast("int")
    checks.append(F.struct(F.lit("expire_logs_days").alias("setting"), F.coalesce(days >= V.MIN_LOG_EXPIRE_DAYS, F.lit(False)).alias("passed")))
    return wide.select("resource", F.explode(F.array(*checks)).alias("_c")).select("resource", "_c.*")


def fire_alerts(
    metrics: DataFrame, ts: str, rules=tuple(V.ALERT_RULES), entity: str = "entity"
) -> DataFrame:
    """One row per alert start: the first sample at which a rule holds after one at which it did not.

    A rule with a duration holds when every sample of the trailing duration
    breaks the limit and the samples span it. ``metrics`` is (entity, metric,
    value, ts); rules are grouped by duration, so there is one window per
    distinct duration. Samples of one time follow each other by value.
    """
    metrics = cut_lineage(metrics.select(entity, "metric", "value", ts))  # read once for all durations
    parts = []
    for minutes in sorted({rule[6] for rule in rules}):
        mine = [r for r in rules if r[6] == minutes]
        breaking = F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.col("metric") == metric,
                            F.struct(
                                F.lit(alert).alias("alert"), F.lit(severity).alias("severity"), F.lit(ack).alias("ack_minutes"),
                                compare_to(F.col("value"), op, F.lit(limit)).alias("broken"),
                            ),
                        )
                        for alert, metric, op, limit, severity, ack, _ in mine
                    ]
                )
            )
        ).alias("_r")
        tagged = metrics.select(entity, "metric", "value", ts, breaking).select(entity, "metric", "value", ts, "_r.*")
        if minutes == 0:
            firing = tagged.withColumn("firing", F.col("broken"))
        else:
            width = minutes * 60_000_000
            windowed = trailing_window(
                tagged, ts, width,
                {"_all": lambda w: F.min(F.col("broken").cast("int")).over(w), "_since": lambda w: F.min(epoch_us(ts)).over(w)},
                [entity, "alert"],
            )
            held = (F.col("_all") == 1) & (epoch_us(ts) - F.col("_since") >= width)
            firing = windowed.withColumn("firing", held).drop("_all", "_since")
        parts.append(firing)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    seen = running_scan(every, [ts, "value"], {"_before": ("last", F.col("firing"))}, keys=[entity, "alert"], inclusive=False)
    starts = seen.where(F.col("firing") & ~F.coalesce("_before", F.lit(False)))
    return starts.select(entity, "alert", "metric", "severity", "ack_minutes", "value", ts)


def decommission_status(
    days_elapsed: Column | float, orphans: DataFrame, attempts: DataFrame, artifacts: DataFrame
) -> DataFrame:
    """Whether the old source may go: day ten, nothing refers to it, backups exist, nobody writes.

    ``orphans`` has resolved, ``attempts`` one row per late write, ``artifacts``
    has kind (backup, log_archive) and done.
    """
    k = F.lit(1).alias("_k")
    days = F.lit(days_elapsed) if isinstance(days_elapsed, (int, float)) else days_elapsed
    refs = orphans.agg(F.count(F.lit(1)).alias("orphans_found"), F.count_if(~F.col("resolved")).alias("orphans_unresolved")).select("*", k)
    writes = attempts.agg(F.count(F.lit(1)).alias("write_attempts")).select("*", k)

    def done(kind: str) -> Column:
        return F.coalesce(F.bool_or(F.when(F.col("kind") == kind, F.col("done"))), F.lit(False))

    kept = artifacts.agg(done("backup").alias("backup_completed"), done("log_archive").alias("log_archived")).select("*", k)
    one = refs.join(writes, "_k").join(kept, "_k").drop("_k")
    one = one.withColumn("days_elapsed", F.round(days.cast("double"), 2)).withColumn("current_day", day_phase(F.floor(days)))
    safe = (
        (F.col("current_day") == "day_10") & (F.col("orphans_unresolved") == 0) & F.col("backup_completed")
        & F.col("log_archived") & (F.col("write_attempts") == 0)
    )
    return one.withColumn("safe_to_terminate", safe)


# --- fixed values: steps of the wind-down (day, step, state when open, state when done) ---
CHECKLIST = [
    ("Day 1–3", "read_only", "PENDING", "COMPLETE"),
    ("Day 1–3", "no_write_attempts", "ACTION_REQUIRED", "COMPLETE"),
    ("Day 4–7", "connection_strings_removed", "PENDING", "IN_PROGRESS"),
    ("Day 4–7", "replicas_offline", "PENDING", "IN_PROGRESS"),
    ("Day 8–9", "final_backup", "PENDING", "COMPLETE"),
    ("Day 8–9", "log_archive", "PENDING", "COMPLETE"),
    ("Day 10", "no_references", "BLOCKING", "COMPLETE"),
    ("Day 10", "deletion_lock", "LOCKED", "UNLOCKED"),
    ("Day 10", "terminate", "BLOCKED", "SAFE"),
    ("Day 40", "delete_volumes", "SCHEDULED", "SCHEDULED"),
]


def decommission_checklist(status: DataFrame, deletion_lock: bool = True) -> DataFrame:
    """State of each wind-down step from the status row."""
    ready = {
        "read_only": F.col("days_elapsed") >= 0,
        "no_write_attempts": F.col("write_attempts") == 0,
        "connection_strings_removed": F.col("days_elapsed") >= 3,
        "replicas_offline": F.col("days_elapsed") >= 3,
        "final_backup": F.col("backup_completed"),
        "log_archive": F.col("log_archived"),
        "no_references": F.col("orphans_unresolved") == 0,
        "deletion_lock": F.lit(not deletion_lock),
        "terminate": F.col("safe_to_terminate"),
        "delete_volumes": F.lit(True),
    }
    steps = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(day).alias("day"), F.lit(step).alias("step"),
                F.when(ready[step], yes).otherwise(no).alias("status"),
            )
            for i, (day, step, no, yes) in enumerate(CHECKLIST, start=1)
        ]
    )
    return status.select(F.explode(steps).alias("_s")).select("_s.*")

