"""A change log as numbered segments, read by offsets: what a broker's source does, on files.

A log has partitions; a record's position in its partition is its offset. Segments of a fixed number of records stand in
folders ``log/partition=P/segment=S/piece=K``, a long segment in several pieces, so which piece holds an offset follows from
its number, and a batch may begin and end inside a file. A piece is what one task reads. ``index`` has the number of records
of each partition and is replaced when the log grows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from driftgate.operators.prefix import running_scan

FORMAT = "segments"
_PIECE_ROWS = 25_000  # of one task of a batch
_SCHEMA = "topic string, partition int, position bigint, offset bigint, value string"


def write_segments(raw: DataFrame, folder: str, rows: int = 100_000) -> None:
    """Store raw records (topic, partition, offset, value) in the order of their offsets, ``rows`` in a segment.

    Positions come from ranges of the whole order, so a partition may be of any size; a piece of a segment is one file.
    """
    numbered = running_scan(raw, ["partition", "offset"], {"position": ("count", F.lit(1))}, keys=["partition"]).withColumn("position", F.col("position") - 1)
    place = ["partition", "segment", "piece"]
    placed = numbered.withColumn("segment", F.floor(F.col("position") / rows)).withColumn("piece", F.floor(F.col("position") % rows / _PIECE_ROWS))
    record = placed.repartition(*place).sortWithinPartitions(*place, "position").select("topic", "position", "offset", "value", *place)
    record.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(*place).json(f"{folder}/log")
    sizes = spark_sizes(record.sparkSession, folder).withColumn("segment_rows", F.lit(rows)).withColumn("piece_rows", F.lit(_PIECE_ROWS))
    sizes.coalesce(1).write.mode("overwrite").json(f"{folder}/index")


def spark_sizes(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.schema("position bigint, partition int").json(f"{folder}/log")
    return stored.groupBy("partition").agg(F.max("position").alias("last"))


@dataclass
class Slice(InputPartition):
    """Records ``skip`` to ``skip + take`` of one piece of a segment."""

    path: str
    partition: int
    skip: int
    take: int


class SegmentSource(DataSource):
    """``spark.readStream.format("segments")`` with options ``path``, ``admitted`` (a folder of the query's own) and ``per_batch``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SegmentReader(self.options["path"], self.options.get("admitted"), int(self.options.get("per_batch", 0)))


class SegmentReader(DataSourceStreamReader):
    """Offsets are records by partition; a batch takes at most ``per_batch`` of each.

    How far batches have been planned is kept in ``admitted``, so a restarted query goes on from there, and a batch that was
    planned and not finished is read again with the offsets of its checkpoint.
    """

    def __init__(self, path: str, admitted: str | None, per_batch: int):
        self.system, self.root = fs.FileSystem.from_uri(path)
        self.per_batch = per_batch
        self.admitted = f"{fs.FileSystem.from_uri(admitted)[1]}/admitted.json" if admitted else None

    def _read_json(self, path: str) -> Iterator[dict]:
        with self.system.open_input_stream(path) as file:
            for line in file.read().decode().splitlines():
                yield json.loads(line)

    def _index(self) -> dict[str, tuple[int, int, int]]:
        """Records, records a segment and records a piece, by partition."""
        files = [x.path for x in self.system.get_file_info(fs.FileSelector(f"{self.root}/index")) if x.path.endswith(".json")]
        return {str(r["partition"]): (r["last"] + 1, r["segment_rows"], r["piece_rows"]) for path in files for r in self._read_json(path)}

    def _planned(self) -> dict[str, int]:
        if self.admitted and self.system.get_file_info(self.admitted).type == fs.FileType.File:
            return next(self._read_json(self.admitted))
        return {}

    def initialOffset(self) -> dict:
        return {p: 0 for p in self._index()}

    def latestOffset(self) -> dict:
        planned = self._planned()
        ends = {p: n for p, (n, _, _) in self._index().items()}
        return {p: min(n, planned.get(p, 0) + self.per_batch) if self.per_batch else n for p, n in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out, planned = [], self._planned()
        for p, (_, rows, piece_rows) in self._index().items():
            at, upto = start.get(p, 0), end.get(p, 0)
            while at < upto:
                segment, inside = divmod(at, rows)
                piece, skip = divmod(inside, piece_rows)
                take = min(upto - at, rows - inside, piece_rows - skip)
                out.append(Slice(f"{self.root}/log/partition={p}/segment={segment}/piece={piece}", int(p), skip, take))
                at += take
        if self.admitted and out:
            ahead = {p: max(n, planned.get(p, 0)) for p, n in end.items()}
            self.system.create_dir(self.admitted.rpartition("/")[0])
            with self.system.open_output_stream(f"{self.admitted}.new") as file:
                file.write(json.dumps(ahead).encode())
            self.system.move(f"{self.admitted}.new", self.admitted)
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        files = [x.path for x in self.system.get_file_info(fs.FileSelector(partition.path)) if x.path.endswith(".json")]
        with self.system.open_input_stream(files[0]) as stream:
            for number, line in enumerate(io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", newline="\n")):
                if number >= partition.skip + partition.take:
                    break
                if number >= partition.skip:
                    r = json.loads(line)
                    yield r["topic"], partition.partition, r["position"], r["offset"], r["value"]

    def commit(self, end: dict) -> None:
        """Nothing to free; what was planned is known from ``admitted``."""


def read_segments(spark: SparkSession, folder: str, admitted: str, per_batch: int = 0) -> DataFrame:
    """The log as a stream of (topic, partition, position, offset, value), ``per_batch`` records of each partition a batch."""
    spark.dataSource.register(SegmentSource)
    return spark.readStream.format(FORMAT).option("path", folder).option("admitted", admitted).option("per_batch", per_batch).load()
