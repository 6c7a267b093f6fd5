"""Time as whole microseconds, whatever timestamp type a table uses."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp with or without time zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def instant_us(text: str) -> int:
    """Microseconds of an ISO-8601 instant, read as UTC."""
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp() * 1_000_000)
