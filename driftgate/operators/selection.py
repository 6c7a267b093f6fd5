"""Exact order statistics of groups of any size, by ranges of the whole order instead of one buffer a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.operators.prefix import add_order_ranges


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """``keys`` and for each name in ``points`` the percentile (0 to 1) of ``value``, interpolated between neighbours.

    Equal values of a group are one row with a count before anything is shuffled. The order of groups and values is cut
    into ranges; counts by group and range (one narrow row each) tell which range holds a rank, and only the rows of those
    ranges are sorted. A group that holds most of the rows is spread over many ranges, and nothing that grows with a group
    is held by one task. Null values are left out; a group without any other has no row. Null keys are a group.
    """
    counted = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"))
    counted = counted.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    staged = add_order_ranges(counted, ["_k", "_v"])
    totals = staged.groupBy("_k", "_range").agg(F.sum("_n").alias("_held"))
    group = Window.partitionBy("_k")  # a row a range
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_k", "_range", "_held", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"), F.sum("_held").over(group).alias("_all"))

    def rank(point: float) -> Column:
        return F.lit(float(point)) * (F.col("_all") - 1)

    sides = [F.struct(F.lit(name).alias("name"), side.alias("side"), at.cast("bigint").alias("at")) for name, p in points.items() for side, at in ((F.lit("lo"), F.floor(rank(p))), (F.lit("hi"), F.ceil(rank(p))))]
    asked = totals.withColumn("_a", F.explode(F.array(*sides))).where((F.col("_a.at") >= F.col("_before")) & (F.col("_a.at") < F.col("_before") + F.col("_held")))
    asked = asked.select("_k", "_range", "_a.name", "_a.side", (F.col("_a.at") - F.col("_before")).alias("_place"), "_all")
    # the few ranges that hold a rank, each with the places asked for in it
    places = asked.groupBy("_k", "_range").agg(F.collect_list(F.struct("name", "side", "_place")).alias("_asked"), F.first("_all").alias("_all"))
    inside = Window.partitionBy("_k", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = staged.join(places, ["_k", "_range"]).withColumn("_upto", F.sum("_n").over(inside))
    hit = reached.withColumn("_h", F.explode("_asked")).where((F.col("_h._place") < F.col("_upto")) & (F.col("_h._place") >= F.col("_upto") - F.col("_n")))

    def of(name: str, side: str) -> Column:
        return F.max(F.when((F.col("_h.name") == name) & (F.col("_h.side") == side), F.col("_v")))

    def between(name: str, point: float) -> Column:
        share = rank(point) - F.floor(rank(point))
        return (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * share).alias(name)

    found = hit.groupBy("_k").agg(F.first("_all").alias("_all"), *[of(n, s).alias(f"_{s}_{n}") for n in points for s in ("lo", "hi")])
    return found.select("_k.*", *[between(n, p) for n, p in points.items()])
