"""Reading a table in key ranges, the way a snapshot does."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgate import fixed_values as V
from driftgate.operators.prefix import running_scan

_RANGE_ROWS = 100_000  # a task sorts a few ranges, however long the table
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def read_range(df: DataFrame, pk: str, start, end=None) -> DataFrame:
    """Rows with ``start <= pk < end``; without ``end`` everything from ``start``.

    A plain comparison on the key, so it reaches the parquet or JDBC scan.
    """
    rows = df.where(F.col(pk) >= F.lit(start))
    return rows if end is None else rows.where(F.col(pk) < F.lit(end))


def read_jdbc_chunks(
    spark: SparkSession, url: str, table: str, pk: str, chunks: list[tuple], readers: int = 8, **options
) -> DataFrame:
    """Parallel JDBC read, one partition per ``(start, end)`` chunk.

    ``readers`` caps how many chunks hit the source at once.
    """
    predicates = [
        f"{pk} >= {start}" if end is None else f"{pk} >= {start} AND {pk} < {end}" for start, end in chunks
    ]
    rows = spark.read.jdbc(url, table, predicates=predicates, properties={k: str(v) for k, v in options.items()})
    return rows.coalesce(max(1, min(readers, len(predicates))))


def chunk_plan(df: DataFrame, table: str, pk: str, size: int = V.CHUNK_SIZE) -> DataFrame:
    """Half-open key ranges covering a table; the last one is open.

    An empty table has no chunks, a key that is not an integer gives one chunk; ``key_chunks`` splits those as well.
    Only the smallest and largest key are computed from the data.
    """
    bounds = df.agg(F.min(pk).alias("low"), F.max(pk).alias("high")).where("low is not null")
    if not isinstance(df.schema[pk].dataType, _INTEGERS):
        return bounds.select(
            F.lit(table).alias("table_name"), F.lit(pk).alias("pk_column"),
            F.lit(0).cast("bigint").alias("chunk_index"),
            F.col("low").cast("string").alias("start_pk"), F.lit(None).cast("string").alias("end_pk"),
        )
    starts = bounds.select(
        "high",
        F.posexplode(
            F.sequence(F.col("low").cast("bigint"), F.col("high").cast("bigint"), F.lit(size).cast("bigint"))
        ).alias("chunk_index", "start_pk"),
    )
    end = F.col("start_pk") + F.lit(size)
    return starts.select(
        F.lit(table).alias("table_name"), F.lit(pk).alias("pk_column"),
        F.col("chunk_index").cast("bigint"), "start_pk",
        F.when(end <= F.col("high"), end).alias("end_pk"),
    )


def slot_of(value: Column, width: int) -> Column:
    """Floor division in whole numbers, right for negative keys as well."""
    whole = value.cast("bigint")
    step = F.lit(width).cast("bigint")
    return F.call_function("div", whole - F.pmod(whole, step), step)


def chunk_of(df: DataFrame, pk: str, size: int = V.CHUNK_SIZE, start: int | None = None) -> Column:
    """Chunk number of each row, counted from the smallest key or from ``start``."""
    low = df.agg(F.min(pk)).scalar() if start is None else F.lit(start)
    return slot_of(F.col(pk) - low, size)


def in_key_order(df: DataFrame, pk: str, partitions: int | None = None) -> DataFrame:
    """Range partitions, each sorted by key: ordered output without a single sorting task."""
    ranged = df.repartitionByRange(partitions, pk) if partitions else df.repartitionByRange(pk)
    return ranged.sortWithinPartitions(pk)


def key_chunks(df: DataFrame, pk: Sequence[str], size: int = V.CHUNK_SIZE) -> DataFrame:
    """Chunks of about ``size`` rows over any orderable key, of one or several columns: chunk_index, start_key, end_key, rows.

    Keys are structs of the key's columns. A chunk takes the rows with start_key <= key < end_key, the last one has no end.
    Split points are the keys at every ``size``-th row of the whole order, found by range, so a chunk has fewer than twice
    ``size`` rows unless one key value has more; equal keys share a chunk. Only the key's columns are read. Rows with a null
    in the key come as one more chunk of index -1 without bounds, if there are any. No rows, no chunks.
    """
    names, key = list(pk), F.struct(*pk)
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names))
    counted = df.select(*names).where(whole).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_scan(counted, names, {"_upto": ("sum", F.col("_n"))}, ranges=_ranges(df))
    step = F.call_function("div", F.col("_upto") - F.col("_n"), F.lit(size).cast("bigint"))
    chunks = placed.groupBy(step.alias("_step")).agg(F.min(key).alias("start_key"), F.sum("_n").alias("rows"))
    ordered = Window.partitionBy(F.lit(0)).orderBy("_step")  # a row a chunk
    listed = chunks.select(
        (F.row_number().over(ordered) - 1).cast("bigint").alias("chunk_index"), "start_key", F.lead("start_key").over(ordered).alias("end_key"), "rows"
    )
    none = F.lit(None).cast(listed.schema["start_key"].dataType)
    lost = df.where(~whole).agg(F.count(F.lit(1)).alias("rows")).where("rows > 0")
    return listed.unionByName(lost.select(F.lit(-1).cast("bigint").alias("chunk_index"), none.alias("start_key"), none.alias("end_key"), "rows"))


def key_range(pk: Sequence[str], start: Row | tuple | None, end: Row | tuple | None) -> Column:
    """start <= key < end on several columns, in plain comparisons; the one on the first column alone can reach the scan."""
    names = list(pk)

    def compare(bound, first: str, equal: bool) -> Column:
        # the largest differing column decides: a > x, or a = x and the rest compares
        rest = F.lit(equal)
        for name, value in reversed(list(zip(names, bound, strict=True))):
            column, limit = F.col(name), F.lit(value)
            beyond = column > limit if first == ">" else column < limit
            rest = beyond | ((column == limit) & rest)
        lead = F.col(names[0]) >= F.lit(bound[0]) if first == ">" else F.col(names[0]) <= F.lit(bound[0])
        return lead & rest

    if start is None:
        return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in names))
    parts = [F.col(c).isNotNull() for c in names[1:]]  # rows with a null in the key are a chunk of their own
    parts += [compare(start, ">", True)] + ([compare(end, "<", False)] if end is not None else [])
    return reduce(lambda a, b: a & b, parts)


def _ranges(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // _RANGE_ROWS))


def in_key_chunks(df: DataFrame, pk: Sequence[str], chunks: DataFrame) -> DataFrame:
    """``df`` with the chunk_index of each row. Chunk starts are carried along the order of keys, range by range.

    Rows of equal keys stay in one range; where a key may hold much of the table, count or gather its rows first.
    """
    names = list(pk)
    others = [c for c in df.columns if c not in names]
    rows = df.select(*names, *([F.struct(*others).alias("_row")] if others else []), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_chunk"))
    starts = chunks.where("chunk_index >= 0").select(*[F.col("start_key")[c].alias(c) for c in names], F.lit(0).alias("_kind"), F.col("chunk_index").alias("_chunk"))
    merged = rows.unionByName(starts, allowMissingColumns=True)
    found = running_scan(merged, [*names, "_kind"], {"chunk_index": ("max", F.col("_chunk"))}, ranges=_ranges(df)).where("_kind = 1")
    null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in names))
    columns = [F.col(c) if c in names else F.col("_row")[c].alias(c) for c in df.columns]
    return found.select(*columns, F.when(null, F.lit(-1).cast("bigint")).otherwise(F.col("chunk_index")).alias("chunk_index"))
