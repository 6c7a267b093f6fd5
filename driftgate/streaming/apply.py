"""Change streams applied exactly once: parse, dead letters, ledger, upserts, fencing."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftgate.operators.cdc import dedup_batch, ledger_rows, net_changes, with_event_id
from driftgate.operators.fencing import audit_rows, fence
from driftgate.sources.cdc import dead_letters, good_events, parse_cdc
from driftgate.sources.tables import BucketedTable, observe_rows, read_ledger, remove_ledger_days, remove_path, write_ledger


def deduplicated(events: DataFrame, event_time: str, horizon: str = "7 days") -> DataFrame:
    """Drop repeats of an event id that arrive within the horizon; state older than it is freed.

    The default is the broker's retention: nothing later can be delivered again.
    """
    return events.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["event_id"])


def split_late(batch: DataFrame, event_time: str, oldest: Column) -> tuple[DataFrame, DataFrame]:
    """Rows a watermark would keep, and those it would drop, so that none is lost silently."""
    late = F.col(event_time) < oldest
    return batch.where(~F.coalesce(late, F.lit(False))), batch.where(late)


class CdcApplier:
    """The body of ``foreachBatch`` for one table's changes.

    Dead letters, late rows and ledger entries of a batch stand in folders of its number that are overwritten when the
    batch runs again, and the ledger is compared with earlier batches only, on the days the batch speaks of. The table
    takes the same batch twice without a change, and writes it ahead: what a driver lost in the middle of the table's own
    commit left undone is done first. A batch that failed half-way is therefore simply repeated. Columns that an image
    leaves out keep the value the table has.

    ``horizon_days`` names how long the ledger is kept: rows older than that against the newest of their batch could not
    be told from repeats and go to ``late`` instead of the table; ``purge`` removes the ledger's older days.
    """

    def __init__(
        self, spark: SparkSession, table: BucketedTable, folder: str, columns: dict[str, str],
        id_mode: str = "row", horizon_days: int | None = None,
    ):
        self.spark = spark
        self.table = table
        self.folder = folder.rstrip("/")
        self.columns = columns
        self.id_mode = id_mode
        self.horizon_days = horizon_days

    def __call__(self, raw: DataFrame, batch_id: int) -> None:
        pk = self.table.pk
        self.table.recover()
        try:
            parsed = parse_cdc(raw)
            parsed = self._stored(parsed.withColumn("value", F.when(F.col("status") == "corrupt", F.col("value"))), "parsed", batch_id)
            failed = dead_letters(parsed)
            failed.write.mode("overwrite").parquet(f"{self.folder}/dead_letters/batch_id={batch_id}")
            events = with_event_id(good_events(parsed), pk, self.id_mode).withColumn("_at", F.timestamp_millis(F.col("ts_ms")))
            days = events.agg(F.min(F.to_date("_at")).alias("first"), F.max(F.to_date("_at")).alias("last"), F.max("_at").alias("newest")).first()
            if self.horizon_days is not None and days["newest"] is not None:
                oldest = F.lit(days["newest"]) - F.make_interval(days=F.lit(self.horizon_days))
                # a commit time of zero stands for an unknown one
                events, late = split_late(events, "_at", F.when(F.col("ts_ms") != 0, oldest))
                late.drop("_at").write.mode("overwrite").parquet(f"{self.folder}/late/batch_id={batch_id}")
            ledger = read_ledger(self.spark, f"{self.folder}/ledger", batch_id, days["first"], days["last"])
            fresh = self._stored(dedup_batch(events.drop("topic", "db", "op_unknown", "_at"), ledger), "fresh", batch_id)
            others = [c for c in self.columns if c not in pk]
            changes = self._stored(self._changes(fresh, others), "changes", batch_id)
            upserts, deletes = changes.where("_alive").drop("_alive"), changes.where("not _alive").select(*pk)
            self.table.write_batch(self._completed(upserts, others), deletes, batch_id)
            write_ledger(ledger_rows(fresh, F.timestamp_millis(F.col("ts_ms"))), f"{self.folder}/ledger", batch_id)
            self._counters(parsed, events, fresh).write.mode("overwrite").parquet(f"{self.folder}/counters/batch_id={batch_id}")
        finally:
            remove_path(self.spark, f"{self.folder}/work/batch_id={batch_id}")

    def _stored(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """The rows as files of the batch, removed when it ends.

        They are read several times, and ``persist`` would not do: what it keeps and what it serializes to disk, up to a
        hundred blocks of rows a task, lies in the executors' heap, so that a batch larger than their storage memory fails.
        """
        path = f"{self.folder}/work/batch_id={batch_id}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _changes(self, fresh: DataFrame, others: Sequence[str]) -> DataFrame:
        """One row a key: its new values, which of them the images left out, and whether it stays."""
        pk = self.table.pk
        return net_changes(fresh, pk, others).select(
            *[F.col(f"_pk_{k}").cast(self.columns[k]).alias(k) for k in pk],
            *[F.col(f"_set_{c}")["v"].cast(self.columns[c]).alias(c) for c in others],
            *[F.col(f"_set_{c}").isNull().alias(f"_keep_{c}") for c in others], "_reset", "_alive",
        )

    def _counters(self, parsed: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
        """One row of the batch's figures; ``watch.sink_totals`` adds the batches up."""

        def number(which: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col("kind") == which, F.col("n"))), F.lit(0)).cast("bigint")

        latest = F.max(F.struct("ts_ms", "offset", "gtid"))
        none = F.lit(None).cast("struct<ts_ms:bigint,offset:bigint,gtid:string>")
        shapes = parsed.where("status <> 'event'").groupBy(F.col("status").alias("kind")).agg(F.count(F.lit(1)).alias("n"), none.alias("latest"))
        given = events.groupBy(F.lit("given").alias("kind")).agg(F.count(F.lit(1)).alias("n"), none.alias("latest"))
        done = fresh.groupBy(F.lit("done").alias("kind")).agg(F.count(F.lit(1)).alias("n"), latest.alias("latest"))
        return shapes.unionByName(given).unionByName(done).agg(
            number("done").alias("events_processed"), (number("given") - number("done")).alias("events_deduplicated"),
            number("corrupt").alias("events_dlq"), number("tombstone").alias("tombstones"), F.max("latest").alias("_latest"),
        ).select(
            "events_processed", "events_deduplicated", "events_dlq", "tombstones", F.col("_latest.gtid").alias("last_gtid"),
            F.col("_latest.ts_ms").alias("last_event_ts_ms"), F.col("_latest.offset").alias("last_offset"),
        )

    def _completed(self, upserts: DataFrame, others: Sequence[str]) -> DataFrame:
        """Columns an image leaves out keep the value the table has, unless the row was deleted in between."""
        held = self.table.read().select(*[F.col(k).alias(f"_held_{k}") for k in self.table.pk], *[F.col(c).alias(f"_old_{c}") for c in others])
        same = F.lit(True)
        for key in self.table.pk:
            same = same & F.col(key).eqNullSafe(F.col(f"_held_{key}"))
        joined = upserts.join(held.hint("merge"), same, "left")  # a table's files are far smaller than its rows in memory
        return joined.select(
            *self.table.pk,
            *[F.when(F.col(f"_keep_{c}") & ~F.col("_reset"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in others],
        )

    def purge(self, today) -> int:
        """Remove the ledger's days beyond the horizon before ``today`` (a date); how many days went."""
        if self.horizon_days is None:
            return 0
        return remove_ledger_days(self.spark, f"{self.folder}/ledger", today - timedelta(days=self.horizon_days))


def run_apply(raw: DataFrame, applier: CdcApplier, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start applying a raw change stream; by default everything available, then stop. Its progress counts the raw records."""
    return (
        observe_rows(raw).writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


class FenceApplier:
    """``foreachBatch`` body that fences writes by epoch.

    The highest epoch per domain is one small table per batch. Inside a batch the
    running maximum is split by range, so one busy domain uses the whole cluster
    instead of one state key.
    """

    def __init__(self, spark: SparkSession, folder: str, domain: str, seq: str = "seq"):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.domain = domain
        self.seq = seq

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        known = self._known(batch_id)
        fenced = fence(batch, self.seq, keys=[self.domain])
        if known is not None:
            fenced = fenced.join(known, self.domain, "left")
            fenced = fenced.withColumn("max_seen", F.greatest("max_seen", F.coalesce("_known", F.lit(0)))).drop("_known")
            fenced = fenced.withColumn("accepted", F.col("epoch") >= F.col("max_seen"))
        fenced = fenced.persist()
        try:
            accepted, violations = audit_rows(fenced, self.seq)
            accepted.write.mode("overwrite").parquet(f"{self.folder}/audit/batch_id={batch_id}")
            violations.write.mode("overwrite").parquet(f"{self.folder}/violations/batch_id={batch_id}")
            newest = fenced.where("accepted").groupBy(self.domain).agg(F.max("epoch").alias("_known"))
            if known is not None:
                newest = newest.unionByName(known).groupBy(self.domain).agg(F.max("_known").alias("_known"))
            newest.write.mode("overwrite").parquet(f"{self.folder}/epochs/batch_id={batch_id}")
        finally:
            fenced.unpersist()

    def _known(self, batch_id: int) -> DataFrame | None:
        """Highest epochs before this batch: each batch's folder holds those of all batches up to it.

        Only the first batch has none. If the folder is gone the batch fails, since without it stale writes would pass.
        """
        if batch_id == 0:
            return None
        return self.spark.read.parquet(f"{self.folder}/epochs/batch_id={batch_id - 1}").select(self.domain, "_known")


def run_batches(stream: DataFrame, body, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
