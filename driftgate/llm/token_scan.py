"""Token counts of flat token files without an index: a vectorised separator scan, stitched across blocks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.common import kept
from driftgate.session import shared_folder

BLOCK_TOKENS = 1 << 22
_SPAN = 1024  # blocks that one window of the first level of the prefix scan covers


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokens: Callable[[str], list[int]], separator: int, folder: str | None = None, dtype: str = "<u2",
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's tokens and a separator after each, one flat file a task; (file, ordinal, id) of each document.

    ``folder`` is one that all executors share, a new one in the checkpoint folder if not given. A task writes under a
    name of its attempt and gives it its final name when it is complete, so that a lost or repeated task leaves no half
    file. Null texts have no tokens. The rows that come back are checkpointed, and only files named in them count.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        number = task.taskAttemptId()  # another one for each attempt
        name = f"{number}.bin"
        ordinal = 0
        with system.open_output_stream(f"{root}/_{name}") as out:
            for batch in batches:
                for value in batch.column(1):
                    out.write(np.array([*tokens(value.as_py() or ""), separator], dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)],
                    names=["number", "ordinal", id_col],
                )
                ordinal += n
        system.move(f"{root}/_{name}", f"{root}/{name}")

    written = kept(source.mapInArrow(run, f"number bigint, ordinal bigint, `{id_col}` {source.schema['_id'].dataType.simpleString()}"))
    return written.select(F.concat(F.lit(f"{folder}/"), F.col("number").cast("string"), F.lit(".bin")).alias("file"), "ordinal", id_col)


def scan(files: DataFrame, separator: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, file_col: str = "file") -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in flat files of token identifiers.

    ``files`` names the files; names that repeat count once, null ones not at all. A document ends at a separator, which
    is not counted; two separators in a row enclose a document of no tokens. Tokens after the last separator are a
    document that is not closed; no tokens there are none, and an empty file has no documents. A file whose size is no
    multiple of the token's raises an error.

    Blocks of ``block_tokens`` are read apart from each other, so one large file is many tasks. Each block gives the
    lengths between its own separators; what a block's first document has in the blocks before comes from a prefix scan
    over one narrow row a block, itself in two levels, so a very long file is no single window either.
    """
    width = np.dtype(dtype).itemsize
    names = files.select(files[file_col].alias("file")).where("file is not null").distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name in batch.column(0).to_pylist():
                system, path = _open(name)
                size = system.get_file_info(path).size
                if size is None or size % width:
                    raise ValueError(f"{name} is missing or ends within a token")
                sizes.append(size // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    # the rows that follow carry a short number in the place of the path
    sized = kept(names.mapInArrow(measure, "path string, size bigint").where("size > 0").withColumn("file", F.xxhash64("path")))
    last = F.floor((F.col("size") - 1) / block_tokens).cast("bigint")
    blocks = kept(sized.select("path", "file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")))
    tasks = max(1, min(blocks.count(), 4 * files.sparkSession.sparkContext.defaultParallelism * 16))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, number, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = _open(name)
                begin = block * block_tokens
                count = min(block_tokens, size - begin)
                with system.open_input_file(path) as file:
                    ids = np.frombuffer(file.read_at(count * width, begin * width), dtype)
                ends = np.flatnonzero(ids == separator)
                # lengths of the documents that end here; of the first, only what is in this block
                lengths = np.diff(ends, prepend=-1) - 1
                n = len(ends)
                rows = [np.full(n + 1, block), np.arange(-1, n), np.append(-1, begin + ends), np.append(count, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * (n + 1), pa.int64()), *(pa.array(r.astype(np.int64)) for r in rows)],
                                                 names=["file", "block", "place", "end", "length"])

    # per block one row with place -1, and one for each separator
    found = kept(blocks.repartition(tasks).mapInArrow(read, "file bigint, block bigint, place bigint, end bigint, length bigint"))
    by_block = found.groupBy("file", "block").agg(
        F.sum(F.when(F.col("place") >= 0, 1).otherwise(0)).alias("n"),
        F.max(F.when(F.col("place") >= 0, F.col("end") + 1)).alias("open_from"),
    )
    # exclusive prefix: how many documents ended before the block, and where the open one began
    by_block = by_block.withColumn("span", F.floor(F.col("block") / _SPAN).cast("bigint"))
    before = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = by_block.groupBy("file", "span").agg(F.sum("n").alias("n"), F.max("open_from").alias("open_from"))
    before_span = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("file", "span", _prefix("n", before_span).alias("span_n"), F.max("open_from").over(before_span).alias("span_from"))
    prefix = by_block.select("file", "block", "span", _prefix("n", before).alias("n"), F.max("open_from").over(before).alias("open_from"))
    prefix = prefix.join(spans, ["file", "span"]).select(
        "file", "block", (F.col("n") + F.col("span_n")).alias("ended"), F.coalesce("open_from", "span_from", F.lit(0)).alias("open_from")
    )
    ended = found.where("place >= 0").join(prefix, ["file", "block"])
    # the first separator of a block closes what was open before it
    start = F.when(F.col("place") == 0, F.col("open_from")).otherwise(F.col("end") - F.col("length"))
    closed = ended.select("file", (F.col("ended") + F.col("place")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = by_block.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("open_from"), F.lit(0)).alias("start"))
    rest = sized.join(whole, "file").where("size > start")
    rest = rest.select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    # one row a file
    return closed.unionByName(rest).join(sized.select("file", "path"), "file").select(F.col("path").alias("file"), "ordinal", "start", "n_tokens", "closed")


def _prefix(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> Callable[[str], list[int]]:
    """Ordinary tokens by a vocabulary file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


def token_counts(docs: DataFrame, path: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row of ``docs``: its text is written to flat token files, and these are scanned.

    Repeated rows stay repeated, a null id stays null, a null or empty text has no tokens, other columns are ignored.
    """
    written = write_token_files(docs, lambda text: byte_pairs(path)(text), separator, id_col=id_col, text_col=text_col)
    counts = scan(written, separator).select("file", "ordinal", "n_tokens")
    return written.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens")


def token_counts_of_files(spark: SparkSession, paths: list[str], separator: int, dtype: str = "<u2") -> DataFrame:
    """The same scan over files from elsewhere."""
    return scan(spark.createDataFrame([(p,) for p in paths], "file string"), separator, dtype)
