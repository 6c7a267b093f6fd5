"""The value in force at a moment: as-of joins between a log and a price-like series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.functions.clock import HOUR_US, epoch_us
from driftgate.operators.prefix import running_scan

SERIES_BROADCAST_ROWS = 200_000
BUCKET_POINTS = 64  # series points that a looked-up row is compared with at most


def asof_join(
    left: DataFrame,
    series: DataFrame,
    left_ts: str,
    series_ts: str,
    values: Sequence[str],
    direction: str = "backward",
    broadcast_rows: int = SERIES_BROADCAST_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """Add to each left row the ``values`` of the nearest series row.

    backward takes the last series row at or before the left time, forward the
    first at or after it. Of series rows of one time the largest ``values`` count.
    Left rows without a match are kept with nulls. A short series without crowded
    hours (both are checked) is turned into intervals and looked up without moving
    the left side; any other is merged into the log and carried forward range by
    range.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    sign = 1 if direction == "backward" else -1
    points = series.where(F.col(series_ts).isNotNull()).select(
        (epoch_us(series_ts) * sign).alias("_at"), F.struct(*values).alias("_value")
    ).groupBy("_at").agg(F.max("_value").alias("_value"))
    timed = left.withColumn("_at", epoch_us(left_ts) * sign)
    bounded = points.limit(broadcast_rows + 1)
    hours = bounded.groupBy(_hour_of(F.col("_at")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    found = hours.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("h").alias("lo"), F.max("h").alias("hi")).first()
    if not found["n"]:
        return timed.select(*left.columns, *[F.lit(None).cast(series.schema[v].dataType).alias(v) for v in values])
    low, high = found["lo"], found["hi"]
    if found["n"] <= broadcast_rows and high - low <= broadcast_rows and found["most"] <= BUCKET_POINTS:
        matched = _lookup(timed, points, high)
        return matched.select(*left.columns, *[F.col("_value")[v].alias(v) for v in values])
    return _merge(timed, points, ranges).select(
        *left.columns, *[F.col("_found")[v].alias(v) for v in values]
    )


def nearest_by_key(
    left: DataFrame, series: DataFrame, key: str, left_at: Column, series_at: Column, value: Column, found: str, direction: str = "backward"
) -> DataFrame:
    """Add ``found``: struct (at, value) of the nearest series row with the left row's key, null without one.

    ``left_at`` and ``series_at`` are microseconds. backward takes the last series row at or before the left time,
    forward the first at or after it; of several at one time, the one with the largest value (smallest for forward).
    Both sides are merged into one order and carried along range by range, so neither a busy key nor a dense hour is
    joined row by row.
    """
    kind = {"backward": "max", "forward": "min"}[direction]
    row = [F.col(c) for c in left.columns]
    asked = left.select(F.col(key).alias("_key"), left_at.alias("_at"), F.struct(*row).alias("_row"), F.monotonically_increasing_id().alias("_tie"))
    held = F.struct(series_at.alias("at"), value.alias("value"))
    marks = series.select(F.col(key).alias("_key"), series_at.alias("_at"), held.alias("_mark")).where("_key is not null and _at is not null")
    asked = asked.withColumn("_mark", F.lit(None).cast(marks.schema["_mark"].dataType))
    # series rows come before left rows of the same time, in either direction
    marks = marks.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).withColumn("_tie", F.lit(-1).cast("bigint"))
    sign = 1 if direction == "backward" else -1
    merged = asked.unionByName(marks).withColumn("_order", F.col("_at") * sign)
    scanned = running_scan(merged, ["_order", "_tie"], {"_found": (kind, F.col("_mark"))}, keys=["_key"])
    usable = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    return scanned.where("_row is not null").select("_row.*", F.when(usable, F.col("_found")).alias(found))


def _merge(timed: DataFrame, points: DataFrame, ranges: int | None) -> DataFrame:
    """Union of both sides in time order; series rows precede left rows of the same time."""
    row = [c for c in timed.columns if c != "_at"]
    log = timed.select(
        "_at", F.monotonically_increasing_id().alias("_tie"), F.struct(*row).alias("_row"),
        F.lit(None).cast(points.schema["_value"].dataType).alias("_value"),
    )
    marks = points.select(
        "_at", F.lit(-1).cast("bigint").alias("_tie"),
        F.lit(None).cast(log.schema["_row"].dataType).alias("_row"), "_value",
    )
    merged = log.where("_at is not null").unionByName(marks)
    scanned = running_scan(merged, ["_at", "_tie"], {"_found": ("last", F.col("_value"))}, ranges=ranges)
    found = scanned.where(F.col("_row").isNotNull()).select("_row.*", "_found")
    untimed = log.where("_at is null").select("_row.*", F.col("_value").alias("_found"))
    return found.unionByName(untimed)


def _lookup(timed: DataFrame, points: DataFrame, last_hour: int) -> DataFrame:
    """Interval lookup by hour. The caller has checked the number of points and of hours.

    The last interval is open; later left rows look it up under the last hour.
    """
    ordered = Window.orderBy("_at")  # a bounded number of points
    intervals = points.select(
        F.col("_at").alias("_from"), "_value", F.lead("_at").over(ordered).alias("_to")
    )
    first = _hour_of(F.col("_from"))
    last = F.coalesce(_hour_of(F.col("_to") - 1), F.lit(last_hour).cast("bigint"))
    by_hour = intervals.select("_from", "_to", "_value", F.explode(F.sequence(first, last)).alias("_hour"))
    hour = F.least(_hour_of(F.col("_at")), F.lit(last_hour))
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    return timed.join(F.broadcast(by_hour), (hour == F.col("_hour")) & inside, "left")


def _hour_of(micros: Column) -> Column:
    hour = F.lit(HOUR_US).cast("bigint")
    return F.call_function("div", micros - F.pmod(micros, hour), hour)
