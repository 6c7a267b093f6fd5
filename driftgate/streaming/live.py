"""Source against target while writes arrive: a stream-stream join on the key, with both sides' delay bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.functions.rows import row_diff, rows_differ
from driftgate.operators.compare import classify_divergence


def live_compare(
    edge: DataFrame, target: DataFrame, pk: str | Sequence[str], columns: Sequence[str], ts: str = "ts", op: str = "operation",
    latency: str = "latency_ms", tolerance: str = "10 minutes", lateness: str = "10 minutes", soft_null: bool = True,
) -> DataFrame:
    """Each write with its class, as soon as both sides have it or the other side's time is up.

    Both streams have the key, ``columns``, the operation, the time and the latency of a write. A write of one side meets
    the write of the same key on the other within ``tolerance``; one that meets none comes out alone when both watermarks
    have passed it, and ``missing`` names the side it was not found on. State is kept for the tolerance only. A write behind
    its watermark is dropped by Spark: let ``lateness`` cover what the sources may delay.
    """
    keys = [pk] if isinstance(pk, str) else list(pk)

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.withWatermark(ts, lateness).select(*[F.col(c).alias(f"{prefix}{c}") for c in (*keys, *columns, ts, op, latency)])

    reach = F.expr(f"INTERVAL {tolerance}")
    near = (F.col(f"_t_{ts}") >= F.col(f"_e_{ts}") - reach) & (F.col(f"_t_{ts}") <= F.col(f"_e_{ts}") + reach)
    for key in keys:
        near = near & (F.col(f"_e_{key}") == F.col(f"_t_{key}"))
    joined = side(edge, "_e_").join(side(target, "_t_"), near, "full_outer")
    has_edge, has_target = F.col(f"_e_{ts}").isNotNull(), F.col(f"_t_{ts}").isNotNull()
    left = {c: (F.col(f"_e_{c}"), edge.schema[c].dataType) for c in columns}
    right = {c: (F.col(f"_t_{c}"), target.schema[c].dataType) for c in columns}
    both = has_edge & has_target
    differs = both & rows_differ(left, right, blank_is_null=True)
    soft = both & rows_differ(left, right, blank_is_null=False) if soft_null else F.lit(False)
    operation = F.coalesce(f"_e_{op}", f"_t_{op}")
    diff = F.when(differs, row_diff(left, right, blank_is_null=True))
    verdict = classify_divergence(operation, has_edge, has_target, diff, F.col(f"_e_{latency}"), F.col(f"_t_{latency}"), hard=differs, soft=soft)
    return joined.select(
        *[F.coalesce(f"_e_{k}", f"_t_{k}").alias(k) for k in keys], operation.alias(op), F.coalesce(f"_e_{ts}", f"_t_{ts}").alias(ts),
        F.when(~has_edge, "edge").when(~has_target, "target").alias("missing"), verdict["class"].alias("divergence_class"),
        verdict["details"].alias("divergence_details"),
    )
