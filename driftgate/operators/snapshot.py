"""Snapshot planning, checksums and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions.clock import HOUR_US
from driftgate.functions.rows import row_hash
from driftgate.operators.timeline import trailing_window
from driftgate.sources.snapshot_reads import chunk_of

_HALF = 2**30


def fingerprint(hashed: Column) -> list[Column]:
    """Order-free digest of a group of row hashes: count, xor and a sum in two halves.

    Plain partial aggregates, so a group of any size is combined before the shuffle.
    """
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(hashed).alias("xor_hash"),
        F.sum(F.shiftright(hashed, 30)).alias("sum_high"),
        F.sum(hashed.bitwiseAND(F.lit(_HALF - 1).cast("bigint"))).alias("sum_low"),
    ]


def chunk_checksums(
    df: DataFrame, pk: str, size: int = V.CHUNK_SIZE, method: str = "xxhash64", start: int | None = None
) -> DataFrame:
    """Row count and digest per key chunk, independent of row order and layout."""
    hashed = df.select(chunk_of(df, pk, size, start).alias("chunk_index"), row_hash(df, method).alias("_h"))
    return hashed.groupBy("chunk_index").agg(*fingerprint(F.col("_h")))


def compare_chunks(
    source: DataFrame, target: DataFrame, pk: str, size: int = V.CHUNK_SIZE, method: str = "xxhash64", start: int = 0
) -> DataFrame:
    """Both sides' digests per chunk and whether they agree."""
    figures = ["row_count", "xor_hash", "sum_high", "sum_low"]
    a = chunk_checksums(source, pk, size, method, start).select(
        "chunk_index", F.struct(*figures).alias("source")
    )
    b = chunk_checksums(target, pk, size, method, start).select(
        "chunk_index", F.struct(*figures).alias("target")
    )
    joined = a.join(b, "chunk_index", "full_outer")
    return joined.select(
        "chunk_index",
        F.coalesce(F.col("source.row_count"), F.lit(0)).cast("bigint").alias("source_rows"),
        F.coalesce(F.col("target.row_count"), F.lit(0)).cast("bigint").alias("target_rows"),
        F.col("source").eqNullSafe(F.col("target")).alias("matches"),
    )


def size_tiers(tables: DataFrame, fk_edges: DataFrame) -> DataFrame:
    """Snapshot tier per table: 1 referenced or largest tenth, 3 smallest three tenths, else 2.

    ``tables`` has table_name and data_bytes; ``fk_edges`` has to_table.
    """
    referenced = fk_edges.select(F.col("to_table").alias("table_name")).distinct().withColumn("is_referenced", F.lit(True))
    largest_first = Window.orderBy(F.desc("data_bytes"), F.asc("table_name"))  # one row per table of a schema
    ranked = tables.join(referenced, "table_name", "left").select(
        "table_name", "data_bytes",
        F.coalesce("is_referenced", F.lit(False)).alias("is_referenced"),
        (F.row_number().over(largest_first) - 1).alias("_rank"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_total"),
    )
    tier = (
        F.when(F.col("is_referenced") | (F.col("_rank") < F.col("_total") * V.TOP_TIER_SHARE), 1)
        .when(F.col("_rank") >= F.col("_total") * V.ARCHIVE_TIER_FROM, 3)
        .otherwise(2)
    )
    return ranked.select("table_name", "data_bytes", "is_referenced", tier.cast("int").alias("tier"))


def referenced_tables(tables: DataFrame, fk_edges: DataFrame) -> DataFrame:
    return tables.join(fk_edges, tables["table_name"] == fk_edges["to_table"], "left_semi")


def chunk_outcomes(attempts: DataFrame, max_retries: int = V.MAX_RETRIES) -> DataFrame:
    """Final state per chunk from its attempts (table_name, chunk_index, attempt, ok, rows, bytes, ts).

    Attempts beyond the retry limit do not count; a chunk without a success within
    it is quarantined.
    """
    tried = attempts.where(F.col("attempt") <= max_retries)
    good = F.when(F.col("ok"), F.struct("attempt", "rows", "bytes", "ts"))
    final = tried.groupBy("table_name", "chunk_index").agg(
        F.min(good).alias("_good"), F.max("attempt").alias("_last"), F.max("ts").alias("_last_ts")
    )
    done = F.col("_good").isNotNull()
    return final.select(
        "table_name", "chunk_index",
        F.when(done, "completed").otherwise("quarantined").alias("status"),
        F.coalesce(F.col("_good.attempt"), F.col("_last")).cast("bigint").alias("retries"),
        F.coalesce(F.col("_good.rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.col("_good.bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.col("_good.ts"), F.col("_last_ts")).alias("ts"),
    )


def snapshot_progress(outcomes: DataFrame, elapsed_seconds: float, total_bytes: Column | int) -> DataFrame:
    """One row of totals: chunks, tables, rows, bytes, MB/s and seconds to go."""
    per_table = outcomes.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("status") == "completed").alias("done"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
    )
    totals = per_table.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(F.col("done") == F.col("chunks")).alias("completed_tables"),
        F.sum("chunks").alias("total_chunks"),
        F.sum("done").alias("completed_chunks"),
        F.sum(F.col("chunks") - F.col("done")).alias("failed_chunks"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("done") < F.col("chunks"), F.col("table_name")))), ","
        ).alias("quarantined_tables"),
        F.sum("rows").alias("rows_transferred"),
        F.sum("bytes").alias("bytes_transferred"),
    )
    total = F.lit(total_bytes) if isinstance(total_bytes, int) else total_bytes
    rate = F.col("bytes_transferred") / F.lit(float(elapsed_seconds))
    return totals.select(
        "*",
        F.round(rate / 1e6, 6).alias("throughput_mbps"),
        F.round(F.try_divide(F.greatest(total - F.col("bytes_transferred"), F.lit(0)), rate), 3).alias("eta_seconds"),
    )


def dead_man(
    progress: DataFrame,
    ts: str,
    done_bytes: str,
    series: str,
    hours: int = V.DEADMAN_HOURS,
    min_bytes: float | None = None,
) -> DataFrame:
    """Alert where the bytes gained inside the window fall short; needs two checkpoints.

    ``progress`` has a checkpoint every half hour or so per ``series`` (a run);
    ``complete`` rows, if that column exists, are left out.
    """
    needed = V.DEADMAN_BYTES_PER_HOUR * hours if min_bytes is None else min_bytes
    running = progress.where(~F.col("complete")) if "complete" in progress.columns else progress
    seen = trailing_window(
        running, ts, hours * HOUR_US,
        {"_oldest": lambda w: F.first(done_bytes).over(w), "checkpoints": lambda w: F.count(F.lit(1)).over(w)}, [series],
    )
    gained = F.col(done_bytes) - F.col("_oldest")
    return seen.select(
        *running.columns, gained.alias("gained_bytes"), "checkpoints",
        ((F.col("checkpoints") >= 2) & (gained < needed)).alias("alert"),
    )


def row_parity(source: DataFrame, target: DataFrame, limit_pct: float = V.ROW_PARITY_PCT) -> DataFrame:
    """Row counts of both sides and whether they agree within ``limit_pct`` percent."""
    sides = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        target.select(F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    counted = sides.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows")
    )
    gap = F.abs(F.col("source_rows") - F.col("target_rows"))
    pct = F.coalesce(F.try_divide(gap, F.col("source_rows")) * 100, F.when(gap == 0, 0.0).otherwise(100.0))
    return counted.select(
        F.col("source_rows").cast("bigint"), F.col("target_rows").cast("bigint"),
        F.round(pct, 6).alias("difference_pct"), (pct <= limit_pct).alias("passed"),
    )

