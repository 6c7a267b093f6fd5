"""Metadata, sensitivity, redaction, keys and traffic on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate import fixed_values as V
from driftgate.functions import changes
from driftgate.functions.hashing import hmac_sha256, key_fingerprint
from driftgate.operators import compare, keys, redact, snapshot, traffic
from driftgate.operators.keys import ForeignKey
from driftgate.plans.registry import check, table
from driftgate.session import shared_folder
from driftgate.sources import corpus, metadata
from driftgate.sources.tables import read_artifact, read_keyed_json, write_artifact

KEY = b"0123456789abcdef0123456789abcdef"

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
]
FOREIGN_KEYS = [
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey", "fk_customer_nation"),
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey", "fk_nation_region"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey", "fk_supplier_nation"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey", "fk_orders_customer"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", "fk_lineitem_orders"),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey", "fk_lineitem_part"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey", "fk_lineitem_supplier"),
]
FK_SQL = "fk(from_table, to_table, name) AS (VALUES " + ", ".join(
    f"('{k.from_table}', '{k.to_table}', '{k.constraint}')" for k in FOREIGN_KEYS
) + ")"

_COLUMNS = {
    "region": ["r_regionkey:int", "r_name:string"],
    "nation": ["n_nationkey:int", "n_name:string", "n_regionkey:int"],
    "customer": ["c_custkey:bigint", "c_name:string", "c_nationkey:int", "c_acctbal:double", "c_mktsegment:string"],
    "supplier": ["s_suppkey:bigint", "s_name:string", "s_nationkey:int", "s_acctbal:double"],
    "part": ["p_partkey:bigint", "p_name:string", "p_brand:string", "p_type:string", "p_size:int", "p_retailprice:double"],
    "orders": ["o_orderkey:bigint", "o_custkey:bigint", "o_orderstatus:string", "o_totalprice:double",
               "o_orderdate:timestamp_ntz", "o_orderpriority:string"],
    "lineitem": ["l_orderkey:bigint", "l_partkey:bigint", "l_suppkey:bigint", "l_linenumber:int", "l_quantity:double",
                 "l_extendedprice:double", "l_discount:double", "l_tax:double", "l_returnflag:string",
                 "l_linestatus:string", "l_shipdate:timestamp_ntz"],
    "events": ["event_id:bigint", "ts:timestamp_ntz", "user_id:bigint", "event_type:string", "value:double", "props:string"],
    "documents": ["doc_id:bigint", "text:string", "lang:string", "source:string", "n_chars:bigint"],
    "embeddings": ["vec_id:bigint", "embedding:array<float>", "label:int"],
    "pages": ["page_id:bigint", "url:string", "html:string"],
    "benchmark": ["item_id:bigint", "text:string"],
    "labels": ["doc_id:bigint", "quality:int", "toxic:int"],
    "conversations": ["conv_id:bigint", "turn:bigint", "role:string", "text:string"],
}


def _columns_sql() -> str:
    parts = []
    for name, columns in _COLUMNS.items():
        for position, column in enumerate(columns, start=1):
            column, kind = column.split(":")
            longest = f'CAST(max(length("{column}")) AS BIGINT)' if kind == "string" else "CAST(NULL AS BIGINT)"
            parts.append(
                f"""SELECT '{name}' AS table_name, '{column}' AS column_name, {position} AS ordinal, '{kind}' AS data_type,
                    count(*) - count("{column}") AS null_count, {longest} AS max_length FROM {name}"""
            )
    return "cols AS (" + " UNION ALL ".join(parts) + ")"


_WIDTH_SQL = {"int": 4, "bigint": 8, "double": 8, "timestamp_ntz": 8}


def _size_sql(kind: str, column: str) -> str:
    if kind == "string":
        return f"coalesce(octet_length(encode({column})), 0)"
    if kind == "array<float>":
        return f"coalesce(len({column}) * 4, 0)"
    return f"CASE WHEN {column} IS NULL THEN 0 ELSE {_WIDTH_SQL[kind]} END"


def _sizes_sql() -> str:
    parts = []
    for name in TABLES:
        size = " + ".join(_size_sql(kind, f'"{column}"') for column, kind in (c.split(":") for c in _COLUMNS[name]))
        parts.append(
            f"""SELECT '{name}' AS table_name, count(*) AS row_count, CAST(sum({size}) AS BIGINT) AS data_bytes,
                round(avg({size}), 2) AS avg_row_bytes FROM {name}"""
        )
    return "sizes AS (" + " UNION ALL ".join(parts) + ")"


_SIZES_SQL = _sizes_sql()
_COLS_SQL = _columns_sql()


def _tables(spark, folder, names=TABLES) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in names}


def _sizes(spark, folder) -> DataFrame:
    return metadata.profile_tables(_tables(spark, folder))


def _columns(spark, folder) -> DataFrame:
    return metadata.profile_columns(_tables(spark, folder)).drop("distinct_values")


@check("src3_metadata_scan", f"WITH {_COLS_SQL} SELECT * FROM cols")
def metadata_scan(spark, folder) -> DataFrame:
    return _columns(spark, folder)


def _place(spark) -> str:
    return f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"


@check("snk3_artifact", f"WITH {_COLS_SQL} SELECT * FROM cols")
def artifact(spark, folder) -> DataFrame:
    """Column facts of all tables written as JSON and read back with their schema."""
    found = _columns(spark, folder)
    path = write_artifact(found, _place(spark), "columns")
    return read_artifact(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields))


@check("src7_keyed_artifact", f"WITH {_COLS_SQL} SELECT table_name, count(*) AS n_columns, CAST(sum(ordinal) AS BIGINT) AS ordinals, CAST(sum(null_count) AS BIGINT) AS nulls FROM cols GROUP BY 1")
def keyed_artifact(spark, folder) -> DataFrame:
    """The same facts as one JSON object with a list for each table, as the map of personal data comes."""
    listed = _columns(spark, folder).groupBy("table_name").agg(F.collect_list(F.struct("column_name", "ordinal", "null_count")).alias("columns"))
    one = listed.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("table_name", "columns")))).alias("value"))  # one short list a table
    path = _place(spark)
    one.coalesce(1).write.text(path)
    kind = "array<struct<column_name:string,ordinal:int,null_count:bigint>>"
    found = read_keyed_json(spark, path, kind, "table_name", "columns").select("table_name", F.inline("columns"))
    return found.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("ordinal").alias("ordinals"), F.sum("null_count").alias("nulls")
    )


@check(
    "src8_text_files",
    """SELECT source, count(*) AS n_texts, CAST(sum(length(url)) AS BIGINT) AS n_chars
       FROM (SELECT 'host' || (page_id % 16) AS source, url FROM pages) GROUP BY 1""",
)
def text_files(spark, folder) -> DataFrame:
    """Addresses of all pages written as files in nested folders, one address a line, and found again by pattern."""
    place = _place(spark)
    pages = table(spark, folder, "pages").select((F.col("page_id") % 16).alias("host"), F.col("url").alias("value"))
    pages.repartition("host").write.partitionBy("host").text(place)
    files = corpus.read_text_files(spark, [place], "*.txt")
    lines = files.select(F.regexp_extract("location", r"host=(\d+)", 1).alias("host"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy(F.concat(F.lit("host"), "host").alias("source")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("line")).alias("n_chars")
    )


_DOC_LINES = """doc_lines AS (SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"""
_MENTIONS = ["http", "@", "0."]


def _document_files(spark, folder) -> DataFrame:
    """Whole documents in nested folders by source, a line a row and 20 000 rows a file at most, read line by line."""
    place = _place(spark)
    rows = table(spark, folder, "documents").select("doc_id", F.hex(F.coalesce("source", F.lit(""))).alias("source"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    named = rows.select("source", F.concat(F.col("doc_id").cast("string"), F.lit("|"), "line").alias("value"))
    named.write.option("lineSep", "\n").option("maxRecordsPerFile", 20_000).partitionBy("source").text(place)
    found = corpus.read_text_lines(spark, [place], "*.txt")
    code = F.regexp_extract("location", r"source=([0-9A-F]*|__HIVE_DEFAULT_PARTITION__)/", 1)
    source = F.when(code == "__HIVE_DEFAULT_PARTITION__", F.lit("")).otherwise(F.unhex(code).cast("string"))
    at = F.locate("|", F.col("line"))
    return found.select(source.alias("source"), F.substring(F.col("line"), F.lit(1), at - 1).cast("bigint").alias("doc_id"), F.substring("line", at + 1, F.length("line")).alias("line"))


@check(
    "src8_document_files",
    f"WITH {_DOC_LINES} SELECT source, count(DISTINCT doc_id) AS n_documents, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM doc_lines GROUP BY 1",
)
def document_files(spark, folder) -> DataFrame:
    return _document_files(spark, folder).groupBy("source").agg(
        F.count_distinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars")
    )


@check(
    "prj24_document_lines",
    f"""WITH {_DOC_LINES}, m AS (SELECT doc_id, min(CASE WHEN contains(line, 'http') THEN 0 WHEN contains(line, '@') THEN 1 ELSE 2 END) AS first_at, count(*) AS lines
            FROM doc_lines WHERE contains(line, 'http') OR contains(line, '@') OR contains(line, '0.') GROUP BY 1)
        SELECT doc_id, ['http', '@', '0.'][first_at + 1] AS pattern, lines FROM m""",
)
def document_mentions(spark, folder) -> DataFrame:
    """The first pattern that each whole document mentions, found line by line."""
    return corpus.scan_lines(_document_files(spark, folder), _MENTIONS, by="doc_id")


@check("src4_table_profile", f"WITH {_SIZES_SQL} SELECT * FROM sizes")
def table_profile(spark, folder) -> DataFrame:
    return _sizes(spark, folder)


@check(
    "agg1_inventory_totals",
    f"""WITH {_SIZES_SQL} SELECT count(*) AS tables, CAST(sum(data_bytes) AS BIGINT) AS total_data_bytes,
        CAST(sum(row_count * 8) AS BIGINT) AS total_index_bytes, CAST(sum(row_count) AS BIGINT) AS total_rows FROM sizes""",
)
def inventory_totals(spark, folder) -> DataFrame:
    return metadata.inventory_totals(_sizes(spark, folder).withColumn("index_bytes", F.col("row_count") * 8))


@check(
    "srt1_largest_tables",
    f"""WITH {_SIZES_SQL} SELECT table_name, data_bytes,
        CAST(row_number() OVER (ORDER BY data_bytes DESC, table_name) AS INTEGER) AS position FROM sizes""",
)
def largest_tables(spark, folder) -> DataFrame:
    return metadata.largest_first(_sizes(spark, folder)).select("table_name", "data_bytes", "position")


@check(
    "win8_size_tiers",
    f"""WITH {_SIZES_SQL}, {FK_SQL}, ranked AS (
            SELECT table_name, data_bytes, table_name IN (SELECT to_table FROM fk) AS is_referenced,
                   row_number() OVER (ORDER BY data_bytes DESC, table_name) - 1 AS r, count(*) OVER () AS n FROM sizes)
        SELECT table_name, data_bytes, is_referenced,
               CASE WHEN is_referenced OR r < n * 0.1 THEN 1 WHEN r >= n * 0.7 THEN 3 ELSE 2 END AS tier FROM ranked""",
)
def size_tiers(spark, folder) -> DataFrame:
    return snapshot.size_tiers(_sizes(spark, folder), metadata.fk_edges(spark, FOREIGN_KEYS))


@check(
    "joi3_referenced_tables",
    f"WITH {_SIZES_SQL}, {FK_SQL} SELECT table_name, row_count FROM sizes WHERE table_name IN (SELECT to_table FROM fk)",
)
def referenced_tables(spark, folder) -> DataFrame:
    found = snapshot.referenced_tables(_sizes(spark, folder), metadata.fk_edges(spark, FOREIGN_KEYS))
    return found.select("table_name", "row_count")


def _pattern_sql(names) -> str:
    return "|".join(names)


_TIER_SQL = f"""CASE WHEN regexp_matches(lower(column_name), '{_pattern_sql(V.PII_TIER1_NAMES)}') THEN 1
     WHEN regexp_matches(lower(column_name), '{_pattern_sql(V.PII_TIER2_NAMES)}') THEN 2
     WHEN data_type = 'text' AND (coalesce(max_length, 0) > 100 OR coalesce(max_length, 0) = 0) THEN 3 END"""
_TYPED_SQL = f"{_COLS_SQL}, typed AS (SELECT * REPLACE (CASE WHEN data_type = 'string' THEN 'text' ELSE data_type END AS data_type) FROM cols)"


def _classified(spark, folder) -> DataFrame:
    typed = _columns(spark, folder).withColumn(
        "data_type", F.when(F.col("data_type") == "string", "text").otherwise(F.col("data_type"))
    )
    return metadata.classify_columns(typed)


@check("prj4_pii_tier", f"WITH {_TYPED_SQL} SELECT table_name, column_name, data_type, max_length, {_TIER_SQL} AS pii_tier FROM typed")
def pii_tier(spark, folder) -> DataFrame:
    return _classified(spark, folder).select("table_name", "column_name", "data_type", "max_length", "pii_tier")


@check(
    "agg18_pii_map",
    f"""WITH {_TYPED_SQL}, found AS (SELECT *, {_TIER_SQL} AS t FROM typed)
        SELECT table_name, string_agg(column_name || ':' || t, ',' ORDER BY ordinal) AS pii_columns FROM found WHERE t IS NOT NULL GROUP BY 1""",
)
def pii_map(spark, folder) -> DataFrame:
    mapped = metadata.pii_map(_classified(spark, folder))
    listed = F.transform("columns", lambda c: F.concat_ws(":", c["column"], c["pii_tier"].cast("string")))
    return mapped.select("table_name", F.array_join(listed, ",").alias("pii_columns"))


@check(
    "agg17_index_columns",
    """SELECT l_returnflag AS table_name, l_linestatus AS index_name,
              array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS columns, min(l_suppkey % 2) = 0 AS is_unique
       FROM lineitem GROUP BY 1, 2""",
)
def index_columns(spark, folder) -> DataFrame:
    """Index rows shaped from lineitem: one index per flag and status, its columns in sequence."""
    rows = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.min(F.col("l_suppkey") % 2).alias("non_unique")
    )
    listed = metadata.indexes(
        rows.select(
            F.col("l_returnflag").alias("table_name"), F.col("l_linestatus").alias("index_name"),
            F.col("l_linenumber").alias("seq"), F.col("l_linenumber").cast("string").alias("column_name"),
            "non_unique", F.lit("BTREE").alias("index_type"),
        )
    )
    return listed.select("table_name", "index_name", F.array_join("columns", ",").alias("columns"), "is_unique")


@check(
    "joi10_inventory",
    f"""WITH {_SIZES_SQL}, {_COLS_SQL}, {FK_SQL},
        c AS (SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal) AS columns FROM cols GROUP BY 1),
        f AS (SELECT from_table, string_agg(name, ',' ORDER BY name) AS foreign_keys FROM fk GROUP BY 1)
        SELECT s.table_name, s.row_count, s.data_bytes, c.columns, f.foreign_keys,
               (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT column_name AS k FROM cols x WHERE x.table_name = s.table_name
                  AND x.null_count = 0 AND x.column_name LIKE '%key')) AS indexes
        FROM sizes s LEFT JOIN c ON s.table_name = c.table_name LEFT JOIN f ON s.table_name = f.from_table""",
)
def inventory(spark, folder) -> DataFrame:
    """Key-like columns without nulls stand in for the indexes of a catalog."""
    columns = _columns(spark, folder)
    index_list = columns.where("column_name like '%key' and null_count = 0").select(
        "table_name", F.col("column_name").alias("index_name"), F.array("column_name").alias("columns")
    )
    whole = metadata.inventory(_sizes(spark, folder), columns, index_list, metadata.fk_edges(spark, FOREIGN_KEYS))

    def names(column: str, field: str):
        return F.array_join(F.transform(column, lambda c: c[field]), ",").alias(column)

    return whole.select(
        "table_name", "row_count", "data_bytes", names("columns", "column_name"),
        names("foreign_keys", "constraint"), names("indexes", "index_name"),
    )


@check(
    "joi7_schema_diff",
    f"""WITH {_COLS_SQL}, a AS (SELECT * FROM cols WHERE table_name = 'customer'), b AS (SELECT * FROM cols WHERE table_name = 'supplier')
        SELECT coalesce(a.ordinal, b.ordinal) AS ordinal, a.column_name AS left_name, a.data_type AS left_type,
               b.column_name AS right_name, b.data_type AS right_type
        FROM a FULL OUTER JOIN b ON a.ordinal = b.ordinal
        WHERE a.column_name IS DISTINCT FROM b.column_name OR a.data_type IS DISTINCT FROM b.data_type""",
)
def schema_diff(spark, folder) -> DataFrame:
    columns = _columns(spark, folder).select("table_name", "ordinal", F.col("column_name").alias("name"), F.col("data_type").alias("type"))
    return compare.schema_diff(columns.where("table_name = 'customer'"), columns.where("table_name = 'supplier'"))


@check(
    "set4_column_union",
    f"""WITH {_COLS_SQL} SELECT column_name, count(*) AS tables, CAST(sum(null_count) AS BIGINT) AS nulls FROM cols
        WHERE table_name IN ('documents', 'conversations') GROUP BY 1""",
)
def column_union(spark, folder) -> DataFrame:
    """Names of two tables with different columns, as one union by name sees them."""
    two = _tables(spark, folder, ["documents", "conversations"])
    union = two["documents"].limit(0).unionByName(two["conversations"].limit(0), allowMissingColumns=True)
    found = metadata.profile_columns(two).where(F.col("column_name").isin(union.columns))
    return found.groupBy("column_name").agg(F.count(F.lit(1)).alias("tables"), F.sum("null_count").alias("nulls"))


# --- redaction -------------------------------------------------------------

_INNER = "".join(f"{b ^ 0x36:02X}" for b in KEY.ljust(64, b"\0"))
_OUTER = "".join(f"{b ^ 0x5C:02X}" for b in KEY.ljust(64, b"\0"))


def hmac_sql(text: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({text}))))"


_TIERS = {"c_name": 1, "c_mktsegment": 2, "c_acctbal": 3}


@check("prj5_hmac", f"SELECT doc_id, {hmac_sql('text')} AS hashed FROM documents")
def hmac_documents(spark, folder) -> DataFrame:
    """Whole texts in four languages, so the bytes hashed are UTF-8."""
    return table(spark, folder, "documents").select("doc_id", hmac_sha256(F.col("text"), KEY).alias("hashed"))


@check(
    "prj6_redact_table",
    f"""SELECT c_custkey, {hmac_sql('c_name')} AS c_name, c_nationkey, c_acctbal, {hmac_sql('c_mktsegment')} AS c_mktsegment FROM customer""",
)
def redact_customer(spark, folder) -> DataFrame:
    return redact.redact_table(table(spark, folder, "customer"), _TIERS, KEY)


@check(
    "prj7_irreversible",
    f"""SELECT bool_and(NOT contains({hmac_sql('c_name')}, '@') AND NOT regexp_full_match({hmac_sql('c_name')}, '[0-9]+')) AS c_name,
               bool_and(NOT regexp_full_match(CAST(c_custkey AS VARCHAR), '[0-9]+')) AS c_custkey FROM customer""",
)
def irreversible(spark, folder) -> DataFrame:
    """One redacted column that passes and one plain number that does not."""
    after = redact.redact_table(table(spark, folder, "customer"), _TIERS, KEY)
    return redact.irreversible(after.withColumn("c_custkey", F.col("c_custkey").cast("string")), ["c_name", "c_custkey"])


@check(
    "prj8_deterministic",
    """SELECT count(DISTINCT k) AS distinct_values, count(*) AS "values", TRUE AS deterministic
       FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders)""",
)
def deterministic(spark, folder) -> DataFrame:
    """Both sides of a foreign key, hashed apart."""
    def side(name: str, column: str) -> DataFrame:
        rows = table(spark, folder, name)
        return rows.select(F.col(column).alias("plain"), hmac_sha256(F.col(column), KEY).alias("hashed"))

    return redact.deterministic(side("customer", "c_custkey").unionByName(side("orders", "o_custkey")), "plain", "hashed")


@check(
    "prj29_key_fingerprint",
    f"SELECT left(sha256('{KEY.decode()}'), 8) AS key_fingerprint, count(*) AS rows_redacted FROM customer",
)
def fingerprint(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").agg(F.count(F.lit(1)).alias("rows_redacted")).select(
        key_fingerprint(KEY).alias("key_fingerprint"), "rows_redacted"
    )


@check(
    "agg27_redaction_counters",
    "SELECT CAST(count(c_name) + count(c_mktsegment) AS BIGINT) AS columns_redacted, count(*) AS tier3_flagged FROM customer",
)
def redaction_counters(spark, folder) -> DataFrame:
    return redact.redaction_counters(table(spark, folder, "customer"), _TIERS)


# --- foreign keys ----------------------------------------------------------

_BROKEN_SQL = "broken AS (SELECT o_orderkey, CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders)"


def _broken_orders(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    moved = F.when(key % 103 == 0, None).when(key % 101 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    return rows.withColumn("o_custkey", moved)


def _orphan_sql() -> str:
    parts = []
    for k in FOREIGN_KEYS:
        child = "broken" if k.from_table == "orders" else k.from_table
        parts.append(
            f"""SELECT '{k.constraint}' AS "constraint", count(*) AS orphans, count(*) = 0 AS passed FROM {child} c
                WHERE c.{k.from_column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {k.to_table} p WHERE p.{k.to_column} = c.{k.from_column})"""
        )
    return " UNION ALL ".join(parts)


@check("joi2_fk_orphans", f"WITH {_BROKEN_SQL} {_orphan_sql()}")
def fk_orphans(spark, folder) -> DataFrame:
    found = _tables(spark, folder, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
    found["orders"] = _broken_orders(spark, folder)
    return keys.fk_check(found, FOREIGN_KEYS)


@check(
    "prj33_null_guard",
    f"""WITH {_BROKEN_SQL} SELECT o_custkey AS "value", count(*) AS "rows" FROM broken
        WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def null_guard(spark, folder) -> DataFrame:
    """Null references are no orphans."""
    return keys.orphan_values(_broken_orders(spark, folder), "o_custkey", table(spark, folder, "customer"), "c_custkey")


_GRAPH_SQL = """edges AS (
    SELECT 't' || c_custkey AS child, 't' || (c_custkey // 8) AS parent FROM customer WHERE c_custkey > 0
    UNION ALL SELECT 't' || c_custkey, 't' || (c_custkey // 8 // 8) FROM customer WHERE c_custkey > 64
    UNION ALL SELECT 't' || c_custkey, 't' || c_custkey FROM customer WHERE c_custkey % 100 = 0
    UNION ALL SELECT 'x' || c_custkey, 'y' || c_custkey FROM customer WHERE c_custkey % 50 = 0
    UNION ALL SELECT 'y' || c_custkey, 'x' || c_custkey FROM customer WHERE c_custkey % 50 = 0)"""


@check(
    "srt6_fk_levels",
    f"""WITH RECURSIVE {_GRAPH_SQL}, walk AS (
            SELECT DISTINCT parent AS t, 0 AS level FROM edges WHERE parent = 't0'
            UNION ALL SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.t AND e.child <> e.parent),
        nodes AS (SELECT child AS t FROM edges UNION SELECT parent FROM edges)
        SELECT n.t AS table_name, CAST(max(w.level) AS INTEGER) AS level FROM nodes n LEFT JOIN walk w ON n.t = w.t GROUP BY 1""",
)
def fk_levels(spark, folder) -> DataFrame:
    return keys.fk_levels(_graph(spark, folder))


def _graph(spark, folder) -> DataFrame:
    """A dependency graph with one node per customer, self references and cycles."""
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select("c_custkey")

    def edge(prefix_child: str, child, prefix_parent: str, parent, where) -> DataFrame:
        return rows.where(where).select(
            F.concat(F.lit(prefix_child), child.cast("string")).alias("from_table"),
            F.concat(F.lit(prefix_parent), parent.cast("string")).alias("to_table"),
        )

    up = F.floor(key / 8)
    return (
        edge("t", key, "t", up, key > 0)
        .unionByName(edge("t", key, "t", F.floor(up / 8), key > 64))
        .unionByName(edge("t", key, "t", key, key % 100 == 0))
        .unionByName(edge("x", key, "y", key, key % 50 == 0))
        .unionByName(edge("y", key, "x", key, key % 50 == 0))
    )


_RING_SQL = f"""{_GRAPH_SQL}, rings AS (
    SELECT * FROM edges
    UNION ALL SELECT 'p' || c_custkey, 'q' || c_custkey FROM customer WHERE c_custkey % 70 = 0
    UNION ALL SELECT 'q' || c_custkey, 'r' || c_custkey FROM customer WHERE c_custkey % 70 = 0
    UNION ALL SELECT 'r' || c_custkey, 'p' || c_custkey FROM customer WHERE c_custkey % 70 = 0
    UNION ALL SELECT 'p' || c_custkey, 't' || c_custkey FROM customer WHERE c_custkey % 70 = 0
    UNION ALL SELECT 's' || c_custkey, 'p' || c_custkey FROM customer WHERE c_custkey % 70 = 0
    UNION ALL SELECT 's' || c_custkey, 'x' || (c_custkey // 50 * 50) FROM customer WHERE c_custkey % 70 = 0)"""


@check(
    "srt6_cyclic_order",
    f"""WITH RECURSIVE {_RING_SQL}, pairs AS (SELECT DISTINCT child, parent FROM rings WHERE child <> parent),
        nodes AS (SELECT child AS t FROM rings UNION SELECT parent FROM rings),
        reach AS (SELECT child AS a, parent AS b FROM pairs UNION SELECT r.a, p.parent FROM reach r JOIN pairs p ON p.child = r.b),
        comp AS (SELECT n.t, coalesce(min(r.b) FILTER (b.a IS NOT NULL), n.t) AS c, count(b.a) > 0 AS cyclic
                 FROM nodes n LEFT JOIN reach r ON r.a = n.t LEFT JOIN reach b ON b.a = r.b AND b.b = n.t GROUP BY n.t),
        up AS (SELECT DISTINCT x.c AS child, y.c AS parent FROM pairs p JOIN comp x ON x.t = p.child JOIN comp y ON y.t = p.parent WHERE x.c <> y.c),
        walk AS (SELECT DISTINCT c, 0 AS level FROM comp WHERE c NOT IN (SELECT child FROM up)
                 UNION SELECT u.child, w.level + 1 FROM walk w JOIN up u ON u.parent = w.c),
        top AS (SELECT c, max(level) AS level FROM walk GROUP BY c)
        SELECT t AS table_name, CAST(level AS INTEGER) AS level, comp.c AS component, cyclic FROM comp JOIN top ON top.c = comp.c""",
)
def cyclic_order(spark, folder) -> DataFrame:
    """The graph above with rings of three tables, a table above each ring and one below it that also hangs from a ring of two."""
    key = F.col("c_custkey")
    ring = table(spark, folder, "customer").where(key % 70 == 0)
    ends = [("p", "q", key), ("q", "r", key), ("r", "p", key), ("p", "t", key), ("s", "p", key), ("s", "x", F.floor(key / 50) * 50)]
    edges = _graph(spark, folder)
    for child, parent, at in ends:
        edges = edges.unionByName(
            ring.select(F.concat(F.lit(child), key.cast("string")).alias("from_table"), F.concat(F.lit(parent), at.cast("bigint").cast("string")).alias("to_table"))
        )
    return keys.fk_order(edges)


@check(
    "rpt1_redaction_report",
    f"""WITH {_BROKEN_SQL} SELECT 'customer' AS table_name, left(sha256('{KEY.decode()}'), 8) AS key_fingerprint,
               CAST(count(c_name) + count(c_mktsegment) AS BIGINT) AS columns_redacted, count(*) AS tier3_flagged,
               (SELECT count(*) FROM broken WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)) AS fk_violations,
               TRUE AS irreversible FROM customer""",
)
def redaction_report(spark, folder) -> DataFrame:
    before = table(spark, folder, "customer")
    after = redact.redact_table(before, _TIERS, KEY)
    orders = _broken_orders(spark, folder).withColumn("o_custkey", hmac_sha256(F.col("o_custkey"), KEY))
    hashed_keys = before.select(hmac_sha256(F.col("c_custkey"), KEY).alias("c_custkey"))
    orphans = keys.fk_check({"orders": orders, "customer": hashed_keys}, FOREIGN_KEYS[3:4])
    return redact.redaction_report(before, after, "customer", _TIERS, orphans, key_fingerprint(KEY))


# --- traffic ---------------------------------------------------------------

VERB_SQL = "CASE event_type WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'SELECT' END"
LOG_SQL = f"""qlog AS (SELECT 'shard_' || (user_id % 8) AS table_name, {VERB_SQL} AS verb, value AS latency_ms, ts, event_id, user_id,
              {VERB_SQL} || ' shard_' || (user_id % 8) || ' WHERE id = ' || event_id || repeat('x', CAST(event_id % 100 AS INTEGER)) AS statement FROM events)"""
TRAFFIC_SQL = f"""{LOG_SQL}, traffic AS (SELECT table_name, """ + ", ".join(
    f"""count(*) FILTER (verb = '{v}') AS {n}_count,
        CAST(coalesce(sum(CAST(latency_ms AS DECIMAL(18,3))) FILTER (verb = '{v}'), 0) AS DOUBLE) AS {n}_total_ms"""
    for n, v in (("select", "SELECT"), ("insert", "INSERT"), ("update", "UPDATE"), ("delete", "DELETE"))
) + " FROM qlog GROUP BY table_name)"


def query_log(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    verb = F.when(kind == "purchase", "INSERT").when(kind == "signup", "UPDATE").when(kind == "error", "DELETE").otherwise("SELECT")
    shard = F.concat(F.lit("shard_"), (F.col("user_id") % 8).cast("string"))
    statement = F.concat(
        verb, F.lit(" "), shard, F.lit(" WHERE id = "), F.col("event_id").cast("string"),
        F.repeat(F.lit("x"), (F.col("event_id") % 100).cast("int")),
    )
    return table(spark, folder, "events").select(
        shard.alias("table_name"), verb.alias("verb"), F.col("value").alias("latency_ms"), "ts", "event_id",
        F.col("user_id").cast("string").alias("client"), statement.alias("statement"),
    )


def _digests(spark, folder) -> DataFrame:
    return query_log(spark, folder).groupBy(F.concat_ws(" ", "verb", "table_name").alias("digest_text")).agg(
        F.count(F.lit(1)).alias("calls"), (F.sum(F.col("latency_ms").cast("decimal(18,3)")) / 1000).cast("double").alias("wait_seconds")
    )


@check("src5_table_io", f"WITH {TRAFFIC_SQL} SELECT * FROM traffic")
def table_io(spark, folder) -> DataFrame:
    return traffic.table_traffic(query_log(spark, folder))


@check(
    "agg2_statement_rates",
    f"""WITH {LOG_SQL}, t AS (SELECT CAST(sum(CAST(latency_ms AS DECIMAL(18,3))) AS DOUBLE) / 1000 AS busy, count(*) FILTER (verb = 'SELECT') AS s,
            count(*) FILTER (verb <> 'SELECT') AS w, count(*) AS n FROM qlog)
        SELECT round(s / busy, 6) AS select_qps, round(w / busy, 6) AS write_qps, round(n / busy, 6) AS total_qps FROM t""",
)
def statement_rates(spark, folder) -> DataFrame:
    return traffic.statement_rates(_digests(spark, folder))


@check(
    "agg3_write_amplification",
    f"""WITH {TRAFFIC_SQL} SELECT round(least(CAST(sum(insert_count + update_count + delete_count) AS DOUBLE) / greatest(sum(insert_count), 1), 20.0::DOUBLE), 2)
        AS write_amplification FROM traffic""",
)
def write_amplification(spark, folder) -> DataFrame:
    return traffic.write_amplification(traffic.table_traffic(query_log(spark, folder)))


_USER_TRAFFIC_SQL = f"""{LOG_SQL}, traffic AS (SELECT user_id AS table_name, count(*) FILTER (verb = 'INSERT') AS insert_count,
     count(*) FILTER (verb = 'UPDATE') AS update_count, count(*) FILTER (verb = 'DELETE') AS delete_count
     FROM (SELECT user_id, verb FROM qlog UNION ALL SELECT user_id, verb FROM qlog, range(20) WHERE verb = 'INSERT' AND user_id % 3 = 0) GROUP BY 1)"""


@check(
    "agg4_batch_write_ratio",
    f"""WITH {_USER_TRAFFIC_SQL} SELECT round(CAST(sum(insert_count) FILTER (update_count + delete_count > 0 AND insert_count > 10 * (update_count + delete_count)) AS DOUBLE)
        / sum(insert_count + update_count + delete_count), 4) AS batch_write_ratio FROM traffic""",
)
def batch_write_ratio(spark, folder) -> DataFrame:
    """Per client as the table; every third client inserts 21 times over."""
    log = query_log(spark, folder).withColumn("table_name", F.col("client"))
    bulk = (F.col("verb") == "INSERT") & (F.col("client").cast("bigint") % 3 == 0)
    return traffic.batch_write_ratio(traffic.table_traffic(log.withColumn("calls", F.when(bulk, 21).otherwise(1))))


@check(
    "agg5_load_patterns",
    f"""WITH {LOG_SQL}, h AS (SELECT CAST(hour(ts) AS INTEGER) AS slot, count(*) AS n FROM qlog GROUP BY 1),
        w AS (SELECT CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS slot, count(*) AS n FROM qlog GROUP BY 1)
        SELECT 'hour' AS pattern, slot, round(CAST(n AS DOUBLE) / max(n) OVER (), 3) AS load FROM h
        UNION ALL SELECT 'weekday', slot, round(CAST(n AS DOUBLE) / max(n) OVER (), 3) FROM w""",
)
def load_patterns(spark, folder) -> DataFrame:
    log = query_log(spark, folder)
    return traffic.load_pattern(log, "ts").select(F.lit("hour").alias("pattern"), "*").unionByName(
        traffic.load_pattern(log, "ts", "weekday").select(F.lit("weekday").alias("pattern"), "*")
    )


@check(
    "agg6_connections",
    """SELECT count(*) FILTER (event_type <> 'view') AS active, count(*) FILTER (event_type = 'view') AS idle,
              round(count(*) / 20000.0::DOUBLE * 100, 2) AS utilisation_pct FROM events""",
)
def connections(spark, folder) -> DataFrame:
    sessions = table(spark, folder, "events").select(F.when(F.col("event_type") == "view", "Sleep").otherwise("Query").alias("command"))
    return traffic.connection_stats(sessions, 20_000)


@check(
    "prj15_statement_verb",
    f"WITH {LOG_SQL} SELECT event_id, verb, substr(statement, 1, 100) AS preview FROM qlog",
)
def statement_verbs(spark, folder) -> DataFrame:
    return query_log(spark, folder).select(
        "event_id", changes.statement_verb(F.col("statement")).alias("verb"),
        changes.statement_preview(F.col("statement")).alias("preview"),
    )


@check(
    "prj21_latency_proxy",
    f"""WITH {TRAFFIC_SQL}, m AS (SELECT *, round(select_total_ms / greatest(select_count, 1), 3) AS s, round(insert_total_ms / greatest(insert_count, 1), 3) AS i FROM traffic)
        SELECT table_name, CASE WHEN select_count > 0 THEN round(s, 3) END AS select_p50, CASE WHEN select_count > 0 THEN round(s * 2, 3) END AS select_p95,
               CASE WHEN insert_count > 0 THEN round(i * 4, 3) END AS insert_p99, CASE WHEN insert_count > 0 THEN round(i * 10, 3) END AS insert_max,
               CASE WHEN insert_count > 0 THEN insert_count END AS insert_calls FROM m""",
)
def latency_proxies(spark, folder) -> DataFrame:
    rows = traffic.with_latency_proxies(traffic.table_traffic(query_log(spark, folder)))
    return rows.select(
        "table_name", F.round("select_latency.p50_ms", 3).alias("select_p50"), F.round("select_latency.p95_ms", 3).alias("select_p95"),
        F.round("insert_latency.p99_ms", 3).alias("insert_p99"), F.round("insert_latency.max_ms", 3).alias("insert_max"),
        F.col("insert_latency.calls").alias("insert_calls"),
    )


@check(
    "prj21_true_latencies",
    f"""WITH {LOG_SQL} SELECT table_name, verb, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
        round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, max(latency_ms) AS max_ms, count(*) AS calls FROM qlog GROUP BY 1, 2""",
)
def true_latencies(spark, folder) -> DataFrame:
    rows = traffic.true_latencies(query_log(spark, folder))
    return rows.select("table_name", "verb", *[F.round(p, 6).alias(p) for p in ("p50_ms", "p95_ms", "p99_ms")], "max_ms", "calls")


@check(
    "srt2_busiest_tables",
    f"""WITH {TRAFFIC_SQL} SELECT table_name, insert_count + update_count + delete_count AS writes FROM traffic ORDER BY writes DESC, table_name LIMIT 10""",
)
def busiest_tables(spark, folder) -> DataFrame:
    """A top-k report: the ten tables with most writes."""
    return traffic.busiest_tables(traffic.table_traffic(query_log(spark, folder)), 10)


@check(
    "srt4_write_attempts",
    f"""WITH {LOG_SQL} SELECT CAST(epoch_us(ts) AS BIGINT) AS at_us, CAST(user_id AS VARCHAR) AS client, substr(statement, 1, 100) AS preview
        FROM qlog WHERE verb IN ('INSERT', 'UPDATE', 'DELETE') AND ts > TIMESTAMP '2024-01-15' ORDER BY ts DESC LIMIT 10""",
)
def write_attempts(spark, folder) -> DataFrame:
    """A top-k report: the ten latest writes after the cutover."""
    found = traffic.write_attempts(query_log(spark, folder), F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")), n=10)
    return found.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "client", "preview")


_PATTERNS = ["license", "@", "https", "the ", "que"]


@check(
    "prj24_reference_scan",
    """SELECT doc_id, CASE """ + " ".join(f"WHEN contains(text, '{p}') THEN '{p}'" for p in _PATTERNS)
    + """ END AS pattern FROM documents WHERE """ + " OR ".join(f"contains(text, '{p}')" for p in _PATTERNS),
)
def reference_scan(spark, folder) -> DataFrame:
    return corpus.scan_references(table(spark, folder, "documents").select("doc_id", "text"), _PATTERNS).select("doc_id", "pattern")
