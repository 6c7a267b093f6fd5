"""Scalar rules of a change stream: op codes, identity, topics, lag, key inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate import fixed_values as V


def decode_op(op: Column) -> Column:
    """c/u/d/r as given, a missing or unknown code becomes r."""
    return F.when(op.isin(V.CHANGE_OPS), op).otherwise(F.lit("r"))


def op_is_unknown(op: Column) -> Column:
    return op.isNotNull() & ~op.isin(V.CHANGE_OPS)


def event_identity(gtid: Column, ts_ms: Column, topic: Column, partition: Column, offset: Column) -> Column:
    """Transaction id, else commit time, else offset; a zero time falls to the full position."""
    position = F.concat_ws(
        ":", F.lit("no-gtid"), topic, partition.cast("string"), offset.cast("string")
    )
    return (
        F.when(F.nullif(gtid, F.lit("")).isNotNull(), gtid)
        .when(ts_ms.isNull(), offset.cast("string"))
        .when(ts_ms != 0, ts_ms.cast("string"))
        .otherwise(position)
    )


def topic_name(prefix: Column, database: Column, table: Column) -> Column:
    return F.concat_ws(".", prefix, database, table)


def dlq_topic_name(prefix: Column) -> Column:
    return F.concat_ws(".", prefix, F.lit("dlq"))


def history_topic_name(prefix: Column) -> Column:
    return F.concat_ws(".", prefix, F.lit("schema-history"))


def topic_parts(topic: Column) -> Column:
    """Prefix, database and table of a topic name."""
    parts = F.split(topic, r"\.", 3)
    return F.struct(
        F.get(parts, F.lit(0)).alias("prefix"),
        F.get(parts, F.lit(1)).alias("database"),
        F.get(parts, F.lit(2)).alias("table"),
    )


def lag_seconds(ts_ms: Column, now_ms: Column) -> Column:
    """Seconds behind ``now``, never negative, two decimals; zero without a time."""
    seconds = F.greatest(F.lit(0.0), (now_ms - ts_ms) / F.lit(1000.0))
    return F.when(ts_ms.isNull() | (ts_ms == 0), F.lit(0.0)).otherwise(F.round(seconds, 2))


def infer_pk(before: Column, after: Column) -> Column:
    """All likely key columns of a change, read from its two images; a caller who knows the key should use that.

    An unchanged column with a plain key name is taken first; without one, any
    column named id or ending in _id.
    """
    names = F.map_keys(before)
    plain = F.filter(
        names,
        lambda n: F.lower(n).isin(V.PK_NAMES) & before[n].eqNullSafe(after[n]),
    )
    by_suffix = F.filter(names, lambda n: (F.lower(n) == "id") | F.lower(n).endswith("_id"))
    return F.when(F.size(plain) > 0, plain).otherwise(by_suffix)


def statement_verb(text: Column) -> Column:
    """First word of a statement, upper case."""
    return F.upper(F.regexp_extract(text, r"^\s*(\w+)", 1))


def statement_preview(text: Column, chars: int = 100) -> Column:
    return F.substring(text, 1, chars)
