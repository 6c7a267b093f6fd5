"""Writes under a fencing epoch: stale ones are rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.operators.prefix import running_scan
from driftgate.session import cut_lineage


def fence(
    writes: DataFrame, seq: str = "seq", epoch: str = "epoch", keys: Sequence[str] = (),
    start_epoch: int = 0, ranges: int | None = None,
) -> DataFrame:
    """Add ``accepted``: the epoch is at least the highest accepted before it.

    A rejected write is below that maximum and cannot raise it, so the plain
    running maximum of all earlier writes is the same number. ``start_epoch`` is
    the highest epoch already recorded.
    """
    scanned = running_scan(
        writes, [seq], {"max_seen": ("max", F.col(epoch).cast("bigint"))}, keys=keys, inclusive=False, ranges=ranges
    )
    known = F.greatest(F.lit(start_epoch).cast("bigint"), F.col("max_seen"))
    return scanned.withColumn("max_seen", known).withColumn("accepted", F.col(epoch) >= F.col("max_seen"))


def audit_rows(fenced: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Accepted writes for the audit table, and the violations."""
    names = [F.col(seq).alias("write_id"), "epoch", "table_name", "operation", "written_at"]
    accepted = fenced.where("accepted").select(*names)
    violations = fenced.where("not accepted").select(*names, "max_seen")
    return accepted, violations


def lost_leases(beats: DataFrame, order: Sequence[str], ok: str, keys: Sequence[str], failures: int = 3) -> DataFrame:
    """Where a lease is lost: the n-th failed heartbeat in a row, per series.

    Failures so far, less the failures there were at the last good beat, is the
    length of the present run of failures; both are running aggregates.
    """
    failed = F.when(F.col(ok), 0).otherwise(1)
    # the second pass reads the first one's result several times
    counted = cut_lineage(running_scan(beats, order, {"_failures": ("sum", failed)}, keys=keys))
    based = running_scan(
        counted, order, {"_base": ("max", F.when(F.col(ok), F.col("_failures")))}, keys=keys
    )
    in_row = F.col("_failures") - F.coalesce("_base", F.lit(0))
    return based.withColumn("failures_in_row", in_row).where(~F.col(ok) & (in_row == failures)).drop("_failures", "_base")
