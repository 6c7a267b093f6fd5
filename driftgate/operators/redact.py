"""Keyed redaction that keeps foreign keys joinable, and its proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions.hashing import hmac_sha256

Tiers = dict[str, int]


def redact_table(df: DataFrame, tiers: Tiers, key: bytes) -> DataFrame:
    """Columns of tier 1 and 2 become keyed hashes, everything else passes through.

    One projection of native expressions: no shuffle, no Python.
    """
    return df.select(
        *[hmac_sha256(F.col(c), key).alias(c) if tiers.get(c) in (1, 2) else F.col(c) for c in df.columns]
    )


def redaction_counters(df: DataFrame, tiers: Tiers) -> DataFrame:
    """Values hashed (nulls are not) and values of tier 3 left to an operator."""
    hashed = [F.count(F.col(c)) for c in df.columns if tiers.get(c) in (1, 2)]
    flagged = [c for c in df.columns if tiers.get(c) == 3]
    total = F.lit(0)
    for part in hashed:
        total = total + part
    return df.agg(
        total.cast("bigint").alias("columns_redacted"),
        (F.count(F.lit(1)) * F.lit(len(flagged))).cast("bigint").alias("tier3_flagged"),
    )


def irreversible(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: no value still looks like an address or a number."""
    checks = [
        F.coalesce(F.bool_and(~(F.col(c).contains("@") | F.col(c).rlike("^[0-9]+$"))), F.lit(True)).alias(c)
        for c in columns
    ]
    return df.agg(*checks)


def deterministic(pairs: DataFrame, value: str, hashed: str) -> DataFrame:
    """Whether every value has one hash, over all sides that hold it.

    ``pairs`` has the plain and the hashed value. Smallest and largest hash per
    value decide, which combines on the map side however often a value occurs.
    """
    per_value = pairs.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.min(hashed).alias("_lo"), F.max(hashed).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    return per_value.agg(
        F.count(F.lit(1)).alias("distinct_values"), F.coalesce(F.sum("_n"), F.lit(0)).alias("values"),
        F.coalesce(F.bool_and(F.col("_lo").eqNullSafe(F.col("_hi"))), F.lit(True)).alias("deterministic"),
    )


def redaction_report(
    before: DataFrame, after: DataFrame, table: str, tiers: Tiers, orphans: DataFrame, fingerprint: Column
) -> DataFrame:
    """One row per table: counters, broken references and the irreversibility proof.

    ``orphans`` is the result of :func:`driftgate.operators.keys.fk_check`.
    """
    hashed = [c for c in before.columns if tiers.get(c) in (1, 2)]
    proof = irreversible(after, hashed).select(
        F.lit(1).alias("_k"), _all([F.col(c) for c in hashed]).alias("irreversible")
    )
    broken = orphans.agg(F.coalesce(F.sum("orphans"), F.lit(0)).cast("bigint").alias("fk_violations"))
    counters = redaction_counters(before, tiers).withColumn("_k", F.lit(1))
    return counters.join(proof, "_k").join(broken.withColumn("_k", F.lit(1)), "_k").select(
        F.lit(table).alias("table_name"), fingerprint.alias("key_fingerprint"),
        "columns_redacted", "tier3_flagged", "fk_violations", "irreversible",
    )


def _all(flags: list[Column]) -> Column:
    answer = F.lit(True)
    for flag in flags:
        answer = answer & flag
    return answer
