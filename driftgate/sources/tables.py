"""Sinks that stay right when a batch is delivered again: upserts, ledgers, dead letters, artifacts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_BROADCAST_KEYS = 100_000  # of a batch, at most


def merge_statement(target: str, batch: str, pk: Sequence[str], columns: Sequence[str]) -> str:
    """MERGE INTO for a catalog table format that supports it; ``_deleted`` marks removals."""
    on = " AND ".join(f"t.`{k}` <=> s.`{k}`" for k in pk)
    sets = ", ".join(f"t.`{c}` = s.`{c}`" for c in columns if c not in pk)
    names = ", ".join(f"`{c}`" for c in columns)
    values = ", ".join(f"s.`{c}`" for c in columns)
    return (
        f"MERGE INTO {target} t USING {batch} s ON {on} WHEN MATCHED AND s._deleted THEN DELETE "
        f"WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED AND NOT s._deleted THEN INSERT ({names}) VALUES ({values})"
    )


def upsert_rows(target: DataFrame, batch: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """Insert-or-replace: the target without the batch's keys, plus the batch."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


class BucketedTable:
    """A keyed table in Parquet, partitioned by a hash of its key; a batch replaces the buckets it touches.

    A batch is written ahead: the whole new content of its buckets goes to a stage of its own beside the table, the stage
    is marked complete, and only then are the buckets overwritten from it. Overwriting removes a bucket before its new
    files are in place, so a driver lost in between leaves the table without it; ``recover`` publishes a complete stage
    again, and the next batch, or the same one run again, begins with that. A stage that was never completed is ignored
    and written anew. Until the recovery a reader may miss buckets; it never sees half of one as a whole.

    ``buckets`` is the number of files a batch rewrites at most; choose it by the size of the table. One writer at a
    time. With a table format that has MERGE, ``merge_statement`` is the better way.
    """

    def __init__(self, spark: SparkSession, path: str, pk: str | Sequence[str], schema: T.StructType | str, buckets: int = 64):
        self.spark = spark
        self.path = path.rstrip("/")
        self.stages = f"{self.path}_staged"
        self.pk = [pk] if isinstance(pk, str) else list(pk)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.buckets = buckets

    def _bucket(self) -> Column:
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in self.pk]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _files(self, path: str | None = None) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_live", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])
        return self.spark.read.schema(stored).parquet(path or self.path)

    def create(self, base: DataFrame) -> None:
        rows = base.select(*self.schema.names).withColumn("_live", F.lit(True)).withColumn("_bucket", self._bucket())
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().where("_live").select(*self.schema.names)

    def write_batch(self, upserts: DataFrame, deletes: DataFrame | None = None, batch_id: int | str | None = None) -> None:
        """Insert or replace whole rows and delete keys. Keys must be unique in the batch.

        A batch that is called again after its stage was completed is published from there; its rows are not read anew.
        """
        recovered = self.recover()
        if batch_id is not None and str(batch_id) in recovered:
            return
        gone = upserts.select(*self.pk)
        if deletes is not None:
            gone = gone.unionByName(deletes.select(*self.pk)).distinct()
        found = gone.groupBy(self._bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # as many as there are buckets
        touched = [r["b"] for r in found]
        if not touched:
            return
        old = self._files().where(F.col("_live") & F.col("_bucket").isin(touched))
        other = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in self.pk])
        if sum(r["n"] for r in found) > _BROADCAST_KEYS:
            other = other.hint("merge")  # Spark knows only the size of the files, and would broadcast many keys
        same = F.lit(True)
        for key in self.pk:
            same = same & F.col(key).eqNullSafe(F.col(f"_gone_{key}"))
        kept = old.join(other, same, "left_anti")
        new = upserts.select(*self.schema.names).withColumn("_live", F.lit(True)).withColumn("_bucket", self._bucket())
        # a bucket without rows would not be overwritten, so each has one row that is not live
        marks = self.spark.createDataFrame([(b,) for b in touched], "_bucket int").withColumn("_live", F.lit(False))
        rows = kept.unionByName(new).unionByName(marks, allowMissingColumns=True)
        name = uuid.uuid4().hex if batch_id is None else str(batch_id)
        self._stage(rows, name)
        self._publish(name)

    def recover(self) -> list[str]:
        """Publish the stage that was completed and perhaps not published, and remove one left half-written; the published batches."""
        found = []
        for name in list_folder(self.spark, self.stages):
            if path_exists(self.spark, f"{self.stages}/{name}/_complete"):
                found.append(name.removeprefix("batch="))
                self._publish(found[-1])
            else:
                remove_path(self.spark, f"{self.stages}/{name}")
        return found

    def _stage(self, rows: DataFrame, batch: str) -> None:
        place = f"{self.stages}/batch={batch}"
        rows.write.partitionBy("_bucket").parquet(f"{place}/rows")
        touch(self.spark, f"{place}/_complete")

    def _publish(self, batch: str) -> None:
        place = f"{self.stages}/batch={batch}"
        rows = self._files(f"{place}/rows").repartition("_bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        # the mark goes first, so a stage half removed is not taken for a complete one
        remove_path(self.spark, f"{place}/_complete")
        remove_path(self.spark, place)


def _on_file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    found, system = _on_file_system(spark, path)
    return system.exists(found)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    found, system = _on_file_system(spark, path)
    return [status.getPath().getName() for status in system.listStatus(found)] if system.exists(found) else []


def remove_path(spark: SparkSession, path: str) -> bool:
    found, system = _on_file_system(spark, path)
    return system.delete(found, True)


def set_time(spark: SparkSession, paths: Sequence[str], seconds: float) -> None:
    """Give files a modification time, in seconds from now."""
    for path in paths:
        found, system = _on_file_system(spark, path)
        system.setTimes(found, int((time.time() + seconds) * 1000), -1)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, there or not there and nothing in between."""
    write_text(spark, path, "")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of a text, in place of any of that name."""
    found, system = _on_file_system(spark, path)
    stream = system.create(found, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_ledger(rows: DataFrame, path: str, batch_id: int) -> None:
    """Ledger entries by day and batch; a repeated batch replaces its own folders.

    A day's rows are brought together first, a busy day's in several tasks: else each task would leave a file for every day.
    """
    named = rows.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "applied_on")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("applied_on", "batch_id").parquet(path)


def read_ledger(spark: SparkSession, path: str, before_batch: int | None = None, first_day=None, last_day=None) -> DataFrame | None:
    """Ledger entries, optionally only those of earlier batches and of some days; None when there is none yet.

    Days are folders, so only the named ones are read. Entries without a day are always among them.
    """
    try:
        ledger = spark.read.parquet(path)
    except AnalysisException:
        return None
    if before_batch is not None:
        ledger = ledger.where(F.col("batch_id") < before_batch)
    day = F.col("applied_on")
    if first_day is not None:
        ledger = ledger.where(day.isNull() | (day >= F.lit(first_day)))
    if last_day is not None:
        ledger = ledger.where(day.isNull() | (day <= F.lit(last_day)))
    return ledger


def remove_ledger_days(spark: SparkSession, path: str, first_kept_day) -> int:
    """Delete the folders of days before ``first_kept_day`` (a date); how many there were."""
    old = [n for n in list_folder(spark, path) if n.startswith("applied_on=") and n[11:21] < str(first_kept_day) and n[11:15].isdigit()]
    return sum(remove_path(spark, f"{path}/{name}") for name in old)


def write_artifact(df: DataFrame, folder: str, name: str, form: str = "json") -> str:
    """Write a result table as JSON or parquet for the next stage to read."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").format(form).save(path)
    return path


PII_MAP_SCHEMA = "table_name string, columns array<struct<column:string,type:string,pii_tier:int>>"
FK_SCHEMA = "from_table string, from_column string, to_table string, to_column string, constraint string"


def read_artifact(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Read a JSON artifact with the schema it must have."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, key: str, value: str) -> DataFrame:
    """A JSON object whose top-level names are data, as (key, value) rows.

    The file form of a per-table map, such as ``{"users": [...]}``.
    """
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, value)
    return text.select(entries)


def observe_rows(df: DataFrame, name: str = "source") -> DataFrame:
    """Attach counts of raw records that streaming progress reports: rows, tombstones and the highest offset."""
    return df.observe(
        name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("tombstones"), F.max("offset").alias("last_offset")
    )
