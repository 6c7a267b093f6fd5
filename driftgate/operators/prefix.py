"""Running aggregates over one long ordered log without sorting it in one task.

A window without a partition key puts every row in one task, and a window per
key does the same to a key that holds a third of the rows. Here the rows are
range-partitioned on the whole order, once, and stored with the number of their
range. Each range is aggregated first (with map-side combine), the small table
of range totals is accumulated, and every range then finishes on its own. The
stored rows keep the ranges fixed, so a rerun of a lost task cannot disagree
with its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.session import cut_lineage


def add_order_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add ``_range``: consecutive slices of the order, of about equal size.

    Any orderable columns will do. Spark samples the whole order for its bounds, so a crowded first column is cut on
    the next one; rows equal in all of ``order`` stay together. The rows are read once for the bounds and once to be
    dealt out, and are then checkpointed: what follows reads that.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(max(2, ranges), *order)
    return cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))


def _total(kind: str, column: Column, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.sum(column)
    if kind == "count":
        return F.count(column)
    if kind == "max":
        return F.max(column)
    if kind == "min":
        return F.min(column)
    if kind == "last":
        return F.max_by(column, F.when(column.isNotNull(), F.struct(*order)))
    raise ValueError(kind)


def _windowed(kind: str, column: Column, window) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](column).over(window)


def _joined(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        both = F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        return F.when(carried.isNotNull() | local.isNotNull(), both)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def running_scan(
    df: DataFrame,
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    inclusive: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Add running measures ``{name: (sum|count|max|min|last, column)}`` in ``order``.

    ``order`` must be total within a key (end it with a tie breaker).
    ``inclusive=False`` leaves the current row out. ``last`` keeps the latest
    value that is not null. With ``ranges`` there are as many tasks, where Spark
    would merge ranges into tasks by their compressed bytes.
    """
    inputs = {name: f"_in_{name}" for name in measures}
    staged = df.select("*", *[column.alias(inputs[n]) for n, (_, column) in measures.items()])
    staged = add_order_ranges(staged, order, ranges)
    slices = ["_range"]
    totals = staged.groupBy(*keys, *slices).agg(
        *[_total(kind, F.col(inputs[n]), order).alias(f"_sum_{n}") for n, (kind, _) in measures.items()]
    )
    # One row per key and slice: without keys never more rows than slices.
    earlier = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    carry_kind = {"count": "sum"}
    carry = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        *[F.col(s).alias(f"_at{s}") for s in slices],
        *[
            _windowed(carry_kind.get(kind, kind), F.col(f"_sum_{n}"), earlier).alias(f"_carry_{n}")
            for n, (kind, _) in measures.items()
        ],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    for name in slices:
        condition = condition & (F.col(name) == F.col(f"_at{name}"))
    if not keys:
        carry = F.broadcast(carry)  # at most as many rows as slices
    joined = staged.join(carry, condition, "left")
    if ranges is not None:
        joined = joined.repartition(ranges, *keys, *slices)
    upto = Window.currentRow if inclusive else -1
    local = Window.partitionBy(*keys, *slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    results = [
        _joined(kind, F.col(f"_carry_{n}"), _windowed(kind, F.col(inputs[n]), local)).alias(n)
        for n, (kind, _) in measures.items()
    ]
    return joined.select(*df.columns, *results)
