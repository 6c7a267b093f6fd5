"""References to a host in configuration text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, folders: Sequence[str], pattern: str = "*.conf") -> DataFrame:
    """Every matching file below the folders, whole: (location, text)."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(list(folders), wholetext=True)
    )
    return files.select(F.col("_metadata.file_path").alias("location"), F.col("value").alias("text"))


def read_text_lines(spark: SparkSession, folders: Sequence[str], pattern: str = "*.conf") -> DataFrame:
    """Every line of the matching files: (location, line). Large files are split between tasks and no row holds a whole one."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(list(folders))
    return files.select(F.col("_metadata.file_path").alias("location"), F.col("value").alias("line"))


def scan_lines(lines: DataFrame, patterns: Sequence[str], by: str = "location", line: str = "line") -> DataFrame:
    """(by, pattern, lines) of the places that mention a pattern: the first pattern in list order, and how many lines mention one.

    What a task has read of a place is one row before the shuffle, so a place of any size is no group.
    """
    first = F.lit(None).cast("int")
    for number, pattern in reversed(list(enumerate(patterns))):
        first = F.when(F.col(line).contains(pattern), F.lit(number)).otherwise(first)
    found = lines.select(by, first.alias("_at")).where("_at is not null").groupBy(by).agg(F.min("_at").alias("_at"), F.count(F.lit(1)).alias("lines"))
    return found.select(by, F.element_at(F.array(*[F.lit(p) for p in patterns]), F.col("_at") + 1).alias("pattern"), "lines")


def scan_references(docs: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """Documents that mention a pattern, with the first pattern (in list order) they mention."""
    first = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        first = F.when(F.col(text).contains(pattern), F.lit(pattern)).otherwise(first)
    found = docs.withColumn("pattern", first).where("pattern is not null")
    words = F.concat(F.lit("Pattern '"), F.col("pattern"), F.lit("' found in config file"))
    return found.withColumn("description", words).drop(text)


def resolve_references(found: DataFrame, resolutions: DataFrame, on: str = "location") -> DataFrame:
    """Mark references an operator has dealt with (on, resolved_by, resolved_at)."""
    latest = resolutions.groupBy(on).agg(F.max_by("resolved_by", "resolved_at").alias("resolved_by"), F.max("resolved_at").alias("resolved_at"))
    return found.join(latest, on, "left").withColumn("resolved", F.col("resolved_at").isNotNull())
