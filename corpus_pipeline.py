"""A corpus in five stages: quality, common lines, near-duplicates, benchmark passages, tokens.

Each stage takes what the one before it kept, as Parquet, and gives it on with the columns of table documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm import bpe, linededup, quality, simhash, winnow
from driftgate.llm.common import fold, table
from driftgate.llm.queries import tokenizer
from driftgate.session import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; learned from labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    return quality.accepted(docs, quality.fit(docs, labels), threshold=0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents or more repeat; n_chars follows the text."""
    found = linededup.drop_common_lines(docs, min_chars=40, min_docs=5)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component that op2 finds: 64-bit SimHash of four-word shingles, linked at four or fewer differing bits."""
    return simhash.one_of_each(docs, words=4, most_differing=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return winnow.without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    found = bpe.encode(docs, tokenizer("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Dictionaries, fingerprints and merges have no SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over table documents, each one's rows written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
