"""The price buffer over micro-batches: what waits is a table between batches, prices are a series and not a state of each slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import HOUR_US, epoch_us
from driftgate.operators.pricing import drain_schedule, route_writes


class DrainApplier:
    """``foreachBatch`` body for one stream of writes and prices in the order of time.

    Rows have ``price`` (and ``ts``) for a new price, or entry_id, table_name, bytes and ts for a write. A batch routes its
    writes at the price in force and gives the waiting ones, old and new, a time of release from all prices so far. Releases
    before the batch's last moment can't be changed by later prices: they are written to ``released/batch_id=N``; the others
    wait on in ``waiting/batch_id=N``, and the prices they may still need go on in ``prices/batch_id=N``. An entry is read
    once a batch for as long as it waits, at most the maximum age, and entries of one table are spread like any others.
    A batch that runs again reads the folders of the batch before and overwrites its own.
    """

    def __init__(
        self, spark: SparkSession, folder: str, baseline: float = V.BASELINE_PRICE_PER_GB, multiplier: float = V.SPIKE_MULTIPLIER,
        max_age_hours: float = V.BUFFER_MAX_AGE_HOURS, deadline_us: int | None = None,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.baseline, self.multiplier, self.max_age_hours, self.deadline_us = baseline, multiplier, max_age_hours, deadline_us
        self.last_batch: int | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            prices = batch.where("price is not null").select(F.col("ts").alias("price_ts"), "price")
            waiting = None
            if batch_id:
                prices = self._read("prices", batch_id - 1).unionByName(prices)
                waiting = self._read("waiting", batch_id - 1)
            writes = batch.where("price is null").drop("price")
            routed = route_writes(writes, prices, baseline=self.baseline, multiplier=self.multiplier, deadline_us=self.deadline_us)
            new = routed.where("decision = 'buffer_to_wal'").select("entry_id", F.col("ts").alias("buffered_at"), "bytes")
            waiting = new if waiting is None else waiting.unionByName(new)
            now = batch.agg(F.max(epoch_us("ts"))).scalar()
            planned = self._planned(waiting, prices).persist()
            due = epoch_us("flush_at") < now
            self._write(planned.where(due), "released", batch_id)
            self._write(planned.where(~due).select(*waiting.columns), "waiting", batch_id)
            # every price that a waiting entry may ask for: from its own time on, and the one in force then
            oldest = now - int(self.max_age_hours * HOUR_US)
            at = epoch_us("price_ts")
            in_force = prices.where(at <= oldest).agg(F.max(at).alias("_at"))
            kept = prices.withColumn("_p", at).join(in_force).where((F.col("_p") > oldest) | (F.col("_p") == F.col("_at"))).select("price_ts", "price")
            self._write(kept, "prices", batch_id)
            planned.unpersist()
        finally:
            batch.unpersist()
        self.last_batch = batch_id

    def _planned(self, waiting: DataFrame, prices: DataFrame) -> DataFrame:
        return drain_schedule(waiting, prices, baseline=self.baseline, multiplier=self.multiplier, max_age_hours=self.max_age_hours)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def _read(self, name: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def released(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/released").drop("batch_id")

    def planned(self) -> DataFrame:
        """When the entries that still wait would go if no other price came."""
        return self._planned(self._read("waiting", self.last_batch), self._read("prices", self.last_batch))
