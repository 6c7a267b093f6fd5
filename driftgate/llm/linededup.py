"""Lines that very many documents repeat, dropped everywhere but in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import ascii_lower, fresh, kept

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, last): keys of lines found in at least ``min_docs`` documents, and the largest id holding each.

    A key stands as two 64-bit hashes. It is first made distinct by document, then counted; both steps combine where the
    rows are read, so a line that a third of all documents share is one row per task by the time it is shuffled.
    """
    return _counted(_lines(docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text")), min_chars), min_docs)


def _lines(source: DataFrame, min_chars: int) -> DataFrame:
    exploded = source.select("_id", F.xxhash64("_text").alias("_th"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    keyed = exploded.select("_id", "_th", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return keyed.select("_id", "_th", "_pos", F.xxhash64("_key").alias("k1"), F.xxhash64(F.lit(1), "_key").alias("k2"))


def _counted(lines: DataFrame, min_docs: int) -> DataFrame:
    once = lines.where("_id is not null").select("k1", "k2", "_id").distinct()
    return once.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("last")).where(F.col("_docs") >= min_docs).drop("_docs")


def drop_common_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lines_col: str | None = None,
    dropped_col: str | None = None,
) -> DataFrame:
    """``docs`` with its columns, the text without common lines; with the line counts if names for them are given.

    Texts are split at \\n. Lines whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents or
    more go, all of them, except in the document with the largest id that holds the key; there all of them stay. The other
    lines stay in their order, joined by \\n.

    An empty text is one empty line; so is a null text, which stays null. Rows with a null id are no document for the
    count and never the last one, so their common lines go. Rows that repeat an id count as one document and each keep or
    lose lines as that document does. Other columns are handed through, whatever their names. No rows give no rows.
    """
    ident, digest, whole_digest, lines, gone = fresh(docs, "id", "th", "own", "lines", "gone")
    source = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    found = _lines(source, min_chars)
    # stored, so that the join below has a shuffle of its own on either side, which Spark splits where a line is very common
    common = kept(_counted(found, min_docs))
    drops = found.join(common, ["k1", "k2"]).where(~F.col("_id").eqNullSafe(F.col("last")))
    drops = drops.groupBy("_id", "_th").agg(F.collect_set("_pos").alias(gone))
    drops = drops.select(F.col("_id").alias(ident), F.col("_th").alias(digest), gone)
    # split before the shuffle of the join, so that the lines are there once, as a column
    text = F.coalesce(docs[text_col], F.lit(""))
    whole = docs.withColumns({lines: F.split(text, "\n"), whole_digest: F.xxhash64(text)})
    joined = whole.join(drops, whole[id_col].eqNullSafe(drops[ident]) & (whole[whole_digest] == drops[digest]), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(places, lambda i: F.get(F.col(lines), i)), "\n")
    counts = {}
    if lines_col:
        counts[lines_col] = F.size(lines).cast("bigint")
    if dropped_col:
        counts[dropped_col] = F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("bigint")
    kept_text = F.when(F.col(gone).isNull(), whole[text_col]).otherwise(left)
    columns = [kept_text.alias(c) if c == text_col else whole[c] for c in docs.columns if c not in counts]
    return joined.select(*columns, *(value.alias(name) for name, value in counts.items()))
