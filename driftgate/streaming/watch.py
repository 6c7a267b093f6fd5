"""Figures of running streams as a table: what a query reports of each batch, gathered by a listener."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from driftgate.sources.tables import list_folder, write_text

PROGRESS = (
    "query string, run string, batch_id bigint, at string, input_rows bigint, duration_ms bigint, watermark string, metrics map<string,map<string,string>>"
)


class ProgressLog(StreamingQueryListener):
    """Writes one small file for each batch of each query, named by query and batch, so a batch that runs again replaces its own.

    ``metrics`` holds what ``DataFrame.observe`` counted in the stream, by its name. Nothing is kept in the driver. A batch
    that found no data reports nothing new and is left out.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows and not p.observedMetrics:
            return
        row = {
            "query": str(p.name or p.id), "run": str(p.runId), "batch_id": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows,
            "duration_ms": p.durationMs.get("triggerExecution"), "watermark": p.eventTime.get("watermark"),
            "metrics": {name: {k: str(v) for k, v in found.asDict().items()} for name, found in p.observedMetrics.items()},
        }
        write_text(self.spark, f"{self.folder}/{row['query']}-{p.batchId}.json", json.dumps(row) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress_table(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``ProgressLog`` wrote: one a query and batch."""
    names = [n for n in list_folder(spark, folder) if n.endswith(".json")]
    return spark.read.schema(PROGRESS).json(folder) if names else spark.createDataFrame([], PROGRESS)


def sink_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of all batches of a sink together: sums, and the position of the latest event."""
    found = spark.read.parquet(f"{folder}/counters")
    latest = F.max(F.when(F.col("last_event_ts_ms").isNotNull(), F.struct("last_event_ts_ms", "last_offset", "last_gtid")))
    return found.agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("events_processed", "events_deduplicated", "events_dlq", "tombstones")],
        latest.alias("_latest"), F.count(F.lit(1)).alias("batches"),
    ).select(
        "events_processed", "events_deduplicated", "events_dlq", "tombstones", F.col("_latest.last_gtid").alias("last_gtid"),
        F.col("_latest.last_event_ts_ms").alias("last_event_ts_ms"), "batches",
    )
