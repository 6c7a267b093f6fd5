"""Ordered rules over micro-batches: the last or largest value of each key travels between batches as a table.

Inside a batch the order is cut into ranges (``running_scan``), so a key that holds most of the rows is no single group, and
nothing of a key is held in memory. Between batches one row a key is written beside the results, in a folder of the batch's
number, and read by the next one; a batch that runs again reads the same folder and overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import HOUR_US, epoch_us
from driftgate.operators.prefix import running_scan


class Carry:
    """``foreachBatch`` body: adds ``_running``, the last or largest value of ``column`` up to each row of its key, and writes what ``rule`` makes of it.

    ``kind`` is last or max; ``inclusive`` says whether a row's own value counts. ``order`` is total within a key (end it
    with a tie breaker) and never goes back between batches. Rows without a value take part and leave it as it is; before a
    key's first value ``_running`` is ``first``, for max at least that. ``rule`` maps the rows with ``_running`` to the rows
    to keep, by the name of a folder; they stand in ``name/batch_id=N``. If the folder of the batch before is gone the
    batch fails, since going on from nothing would give wrong results silently.
    """

    def __init__(
        self, spark: SparkSession, folder: str, key: str, order: list[str], column: str, first: Column,
        rule: Callable[[DataFrame], dict[str, DataFrame]], kind: str = "last", inclusive: bool = False,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.key, self.order, self.column, self.first, self.rule = key, order, column, first, rule
        self.kind, self.inclusive = kind, inclusive

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        known = self.spark.read.parquet(f"{self.folder}/carried/batch_id={batch_id - 1}") if batch_id else None
        scanned = running_scan(batch, self.order, {"_running": (self.kind, F.col(self.column))}, keys=[self.key], inclusive=self.inclusive)
        both = F.greatest if self.kind == "max" else F.coalesce
        running = F.col("_running")
        if known is not None:
            held = known.select(F.col(self.key).alias("_held_key"), F.col("_carried.value").alias("_held"))
            scanned = scanned.join(held, F.col(self.key).eqNullSafe(F.col("_held_key")), "left").withColumn("_running", both(running, F.col("_held")))
            scanned = scanned.drop("_held_key", "_held")
        scanned = scanned.withColumn("_running", both(running, self.first)).persist()
        try:
            for name, found in self.rule(scanned).items():
                found.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")
        finally:
            scanned.unpersist()
        value = F.col(self.column)
        newest = F.max(value) if self.kind == "max" else F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        now = batch.groupBy(self.key).agg(F.struct(F.lit(batch_id).alias("batch"), newest.alias("value")).alias("_carried")).where("_carried.value is not null")
        if known is not None:
            latest = F.max_by("_carried", "_carried.value" if self.kind == "max" else "_carried.batch")
            now = known.select(self.key, "_carried").unionByName(now).groupBy(self.key).agg(latest.alias("_carried"))
        now.write.mode("overwrite").parquet(f"{self.folder}/carried/batch_id={batch_id}")

    def results(self, name: str = "out") -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").drop("batch_id")


def band_alerts(spark: SparkSession, folder: str) -> Carry:
    """Alerts on a change of the risk band, from batches of (run_id, ts_ms, band): run_id, ts_ms, previous, band, alert."""

    def rule(rows: DataFrame) -> dict[str, DataFrame]:
        band, before = F.col("band"), F.col("_running")
        alert = (
            F.when((band == "BLOCK") & (before != "BLOCK"), "on_block")
            .when((band == "CAUTION") & (before == "PROCEED"), "on_caution")
            .when((band == "PROCEED") & before.isin("BLOCK", "CAUTION"), "on_proceed")
        )
        found = rows.select("run_id", "ts_ms", before.alias("previous"), "band", alert.alias("alert"))
        return {"out": found.where("alert is not null")}

    return Carry(spark, folder, "run_id", ["ts_ms", "band"], "band", F.lit("PROCEED"), rule)


def clean_clock(spark: SparkSession, folder: str, start_us: int, hours: float = V.CLEAN_WINDOW_HOURS) -> Carry:
    """Hours since the last class A (or the start) at every comparison of (stream_id, comparison_id, ts, divergence_class), and whether the window is complete.

    A class A at any time starts the clock anew, in whichever batch it comes.
    """

    def rule(rows: DataFrame) -> dict[str, DataFrame]:
        clean = (epoch_us("ts") - F.col("_running")) / HOUR_US
        return {"out": rows.select("stream_id", "comparison_id", F.round(clean, 6).alias("clean_hours"), (clean >= hours).alias("window_complete"))}

    body = Carry(spark, folder, "stream_id", ["ts", "comparison_id"], "_hit", F.lit(start_us).cast("bigint"), rule, "max", inclusive=True)
    return body


def with_hits(comparisons: DataFrame) -> DataFrame:
    """What ``clean_clock`` carries: the time of each class A."""
    return comparisons.withColumn("_hit", F.when(F.col("divergence_class") == "A", epoch_us("ts")))


def late_split(spark: SparkSession, folder: str, key: str, order: list[str], time_us: str, horizon_us: int) -> Carry:
    """Rows in time stand in ``out``, rows behind the newest earlier row of their key by more than the horizon in ``late``.

    What is late follows from the order of arrival alone, not from where batches end; a row without a time is in time.
    """

    def rule(rows: DataFrame) -> dict[str, DataFrame]:
        late = F.coalesce(F.col(time_us) < F.col("_running") - horizon_us, F.lit(False))
        return {"out": rows.where(~late).drop("_running"), "late": rows.where(late).drop("_running")}

    return Carry(spark, folder, key, order, time_us, F.lit(None).cast("bigint"), rule, "max")
