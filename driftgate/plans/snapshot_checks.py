"""Range reads, chunk plans, checksums, hash trees and repair on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.functions.rows import canonical_row, row_hash, text_bytes
from driftgate.operators import merkle, snapshot
from driftgate.plans.inputs import (
    EDGE_SQL, ORDERS_TEXT, TARGET_SQL, edge_orders, floor_div_sql, hex_number_sql, target_orders,
)
from driftgate.plans.registry import check, table
from driftgate.session import cut_lineage
from driftgate.sources import snapshot_reads

_SPLIT = 5000
_CHUNK = 4096
_LEAF = 256
_FANOUT = 16
_HASH = hex_number_sql(f"md5({ORDERS_TEXT})", 1, 15)


@check(
    "src1_range_scan",
    f"""SELECT CASE WHEN l_orderkey < {_SPLIT} THEN 'bounded' ELSE 'open' END AS range_kind,
               count(*) AS n_rows, CAST(min(l_orderkey) AS BIGINT) AS low, CAST(max(l_orderkey) AS BIGINT) AS high,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
        FROM lineitem WHERE l_orderkey >= 0 GROUP BY 1""",
)
def range_scan(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    bounded = snapshot_reads.read_range(rows, "l_orderkey", 0, _SPLIT).withColumn("range_kind", F.lit("bounded"))
    rest = snapshot_reads.read_range(rows, "l_orderkey", _SPLIT).withColumn("range_kind", F.lit("open"))
    return bounded.unionByName(rest).groupBy("range_kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
    )


@check(
    "src2_chunk_plan",
    f"""SELECT 'orders' AS table_name, 'o_orderkey' AS pk_column, CAST((s - lo) // {_CHUNK} AS BIGINT) AS chunk_index,
               CAST(s AS BIGINT) AS start_pk,
               CASE WHEN s + {_CHUNK} <= hi THEN CAST(s + {_CHUNK} AS BIGINT) END AS end_pk
        FROM (SELECT lo, hi, unnest(range(lo, hi + 1, {_CHUNK})) AS s
              FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders))
        UNION ALL
        SELECT 'customer', 'c_name', 0, NULL, NULL FROM (SELECT min(c_name) AS lo FROM customer) WHERE lo IS NOT NULL""",
)
def chunk_plan(spark, folder) -> DataFrame:
    whole = snapshot_reads.chunk_plan(table(spark, folder, "orders"), "orders", "o_orderkey", _CHUNK)
    text = snapshot_reads.chunk_plan(table(spark, folder, "customer"), "customer", "c_name")
    return whole.unionByName(
        text.select("table_name", "pk_column", "chunk_index", F.lit(None).cast("bigint").alias("start_pk"),
                    F.lit(None).cast("bigint").alias("end_pk"))
    )


_KEY_CHUNK = 700
#: Chunks over a composite key with a text first, and over a text key where a third of the rows share one value.
_KEYED_SQL = f"""keyed AS (
        SELECT 'lineitem' AS t, l_returnflag AS a, CAST(l_orderkey AS BIGINT) AS b, CAST(l_linenumber AS BIGINT) AS c FROM lineitem
        UNION ALL SELECT 'orders', CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE o_orderpriority || o_custkey END, 0, 0 FROM orders),
    distinct_keys AS (SELECT t, a, b, c, count(*) AS n FROM keyed GROUP BY ALL),
    placed AS (SELECT *, (sum(n) OVER (PARTITION BY t ORDER BY a, b, c ROWS UNBOUNDED PRECEDING) - n) // {_KEY_CHUNK} AS step FROM distinct_keys),
    numbered AS (SELECT *, dense_rank() OVER (PARTITION BY t ORDER BY step) - 1 AS chunk_index FROM placed)"""


def _keyed(spark, folder) -> dict[str, tuple[DataFrame, list[str]]]:
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_orderkey").cast("bigint").alias("b"), F.col("l_linenumber").cast("bigint").alias("c"))
    text = F.when(F.col("o_orderkey") % 3 == 0, "M").otherwise(F.concat("o_orderpriority", F.col("o_custkey").cast("string")))
    orders = table(spark, folder, "orders").select(text.alias("a"))
    return {"lineitem": (lines, ["a", "b", "c"]), "orders": (orders, ["a"])}


@check(
    "src2_key_chunks",
    f"""WITH {_KEYED_SQL}, starts AS (SELECT t, CAST(chunk_index AS BIGINT) AS chunk_index, min(row(a, b, c)) AS s, CAST(sum(n) AS BIGINT) AS n_rows FROM numbered GROUP BY t, chunk_index)
        SELECT t AS table_name, chunk_index, s[1] AS start_a, s[2] AS start_b, s[3] AS start_c, lead(s[1]) OVER (PARTITION BY t ORDER BY chunk_index) AS end_a, n_rows FROM starts""",
)
def key_chunks(spark, folder) -> DataFrame:
    """Equal shares of keys that are no single integer."""
    parts = []
    for name, (rows, pk) in _keyed(spark, folder).items():
        found = snapshot_reads.key_chunks(rows, pk, _KEY_CHUNK)
        start = [F.col("start_key")[c] if c in pk else F.lit(0).cast("bigint") for c in ("a", "b", "c")]
        parts.append(found.select(
            F.lit(name).alias("table_name"), "chunk_index", *[s.alias(f"start_{c}") for s, c in zip(start, ("a", "b", "c"), strict=True)],
            F.col("end_key")["a"].alias("end_a"), F.col("rows").alias("n_rows"),
        ))
    return parts[0].unionByName(parts[1])


@check(
    "src1_key_ranges",
    f"""WITH {_KEYED_SQL} SELECT t AS table_name, CAST(chunk_index AS BIGINT) AS chunk_index, a, b, c, CAST(n AS BIGINT) AS n_rows FROM numbered""",
)
def key_ranges(spark, folder) -> DataFrame:
    """The chunk of every key and its rows, by carrying the chunk starts along the order. Rows are counted by key first: one key has a third of them."""
    parts = []
    for name, (rows, pk) in _keyed(spark, folder).items():
        counted = rows.groupBy(*pk).agg(F.count(F.lit(1)).alias("n_rows"))
        found = snapshot_reads.in_key_chunks(counted, pk, snapshot_reads.key_chunks(rows, pk, _KEY_CHUNK))
        columns = [F.col(c) if c in pk else F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "c")]
        parts.append(found.select(F.lit(name).alias("table_name"), "chunk_index", *columns, "n_rows"))
    return parts[0].unionByName(parts[1])


@check(
    "prj31_chunk_of_row",
    f"""SELECT CAST((o_orderkey - (SELECT min(o_orderkey) FROM orders)) // {_CHUNK} AS BIGINT) AS chunk_index,
               count(*) AS n_rows, min(o_orderkey) AS low, max(o_orderkey) AS high
        FROM orders GROUP BY 1""",
)
def chunk_of_row(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders")
    return rows.groupBy(snapshot_reads.chunk_of(rows, "o_orderkey", _CHUNK).alias("chunk_index")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")
    )


@check("prj26_canonical_row", f"SELECT o_orderkey, {ORDERS_TEXT} AS row_text FROM orders")
def canonical_rows(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders")
    return rows.select("o_orderkey", canonical_row(rows).alias("row_text"))


@check(
    "prj30_row_bytes",
    f"""SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(octet_length(encode({ORDERS_TEXT}))) AS BIGINT) AS total_bytes
        FROM orders GROUP BY 1""",
)
def bytes_of_rows(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders")
    sized = rows.select("o_orderstatus", text_bytes(rows).alias("b"))
    return sized.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("b").alias("total_bytes"))


@check(
    "agg11_chunk_checksums",
    f"""SELECT CAST(o_orderkey // {_CHUNK} AS BIGINT) AS chunk_index, count(*) AS row_count,
               CAST(bit_xor(h) AS BIGINT) AS xor_hash, CAST(sum(h >> 30) AS BIGINT) AS sum_high,
               CAST(sum(h & {2**30 - 1}) AS BIGINT) AS sum_low
        FROM (SELECT o_orderkey, {_HASH} AS h FROM orders) GROUP BY 1""",
)
def checksums(spark, folder) -> DataFrame:
    return snapshot.chunk_checksums(table(spark, folder, "orders"), "o_orderkey", _CHUNK, "md5", start=0)


@check(
    "agg11_chunk_compare",
    f"""WITH {EDGE_SQL}, {TARGET_SQL},
        a AS (SELECT {floor_div_sql('o_orderkey', 512)} AS c, count(*) AS n, list_sort(list({ORDERS_TEXT})) AS rows_text
              FROM edge GROUP BY 1),
        b AS (SELECT {floor_div_sql('o_orderkey', 512)} AS c, count(*) AS n, list_sort(list({ORDERS_TEXT})) AS rows_text
              FROM target GROUP BY 1)
        SELECT CAST(coalesce(a.c, b.c) AS BIGINT) AS chunk_index, coalesce(a.n, 0) AS source_rows,
               coalesce(b.n, 0) AS target_rows, a.rows_text IS NOT DISTINCT FROM b.rows_text AS matches
        FROM a FULL OUTER JOIN b ON a.c = b.c""",
)
def chunk_compare(spark, folder) -> DataFrame:
    return snapshot.compare_chunks(edge_orders(spark, folder), target_orders(spark, folder), "o_orderkey", 512)


def _tree_sql(side: str, levels: int) -> str:
    """Levels of the tree of one side as CTEs ``{side}_0 .. {side}_root``."""
    parts = [
        f"""{side}_0 AS (
          SELECT {floor_div_sql('o_orderkey', _LEAF)} AS node, count(*) AS row_count,
                 sha256(concat_ws(':', count(*), bit_xor(h), sum(h >> 30), sum(h & {2**30 - 1}))) AS digest
          FROM (SELECT *, {_HASH} AS h FROM {side}) GROUP BY 1)"""
    ]
    for level in range(1, levels + 1):
        parts.append(
            f"""{side}_{level} AS (
          SELECT {floor_div_sql('node', _FANOUT)} AS node, sum(row_count) AS row_count,
                 sha256(string_agg(digest, ',' ORDER BY node)) AS digest
          FROM {side}_{level - 1} GROUP BY 1)"""
        )
    parts.append(
        f"""{side}_root AS (
          SELECT 0 AS node, sum(row_count) AS row_count, sha256(string_agg(digest, ',' ORDER BY node)) AS digest
          FROM {side}_{levels})"""
    )
    return ",\n".join(parts)


_LEVELS = 4  # 256 rows x 16^4 leaves below each top node

_TREE_ROWS = " UNION ALL ".join(
    [f"SELECT {level} AS level, node, row_count, digest FROM edge_{level}" for level in range(_LEVELS + 1)]
    + [f"SELECT {_LEVELS + 1}, node, row_count, digest FROM edge_root"]
)


def _tree(df: DataFrame) -> list[DataFrame]:
    return merkle.merkle_build(merkle.merkle_leaves(df, "o_orderkey", _LEAF, "md5"), _FANOUT, _LEVELS)


@check(
    "agg12_merkle_tree",
    f"""WITH {EDGE_SQL}, {_tree_sql('edge', _LEVELS)}
        SELECT CAST(level AS BIGINT) AS level, CAST(node AS BIGINT) AS node, CAST(row_count AS BIGINT) AS row_count, digest
        FROM ({_TREE_ROWS})""",
)
def merkle_tree(spark, folder) -> DataFrame:
    levels = _tree(edge_orders(spark, folder))
    tagged = [df.withColumn("level", F.lit(i).cast("bigint")) for i, df in enumerate(levels)]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result


_DIRTY_SQL = f"""dirty AS (
    SELECT coalesce(a.node, b.node) AS node, coalesce(a.row_count, 0) AS source_rows, coalesce(b.row_count, 0) AS target_rows
    FROM edge_0 a FULL OUTER JOIN target_0 b ON a.node = b.node WHERE a.digest IS DISTINCT FROM b.digest)"""


@check(
    "agg12_merkle_diff",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, {_tree_sql('edge', 0)}, {_tree_sql('target', 0)}, {_DIRTY_SQL}
        SELECT CAST(node AS BIGINT) AS node, CAST(source_rows AS BIGINT) AS source_rows,
               CAST(target_rows AS BIGINT) AS target_rows FROM dirty""",
)
def merkle_diff(spark, folder) -> DataFrame:
    a = merkle.cut_lineage(merkle.merkle_leaves(edge_orders(spark, folder), "o_orderkey", _LEAF))
    b = merkle.cut_lineage(merkle.merkle_leaves(target_orders(spark, folder), "o_orderkey", _LEAF))
    return merkle.merkle_diff(
        merkle.merkle_build(a, _FANOUT, _LEVELS), merkle.merkle_build(b, _FANOUT, _LEVELS), _FANOUT
    )


@check(
    "agg12_merkle_roots",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, {_tree_sql('edge', _LEVELS)}, {_tree_sql('target', _LEVELS)}
        SELECT (SELECT digest FROM edge_root) = (SELECT digest FROM target_root) AS roots_match""",
)
def merkle_roots(spark, folder) -> DataFrame:
    return merkle.roots_match(_tree(edge_orders(spark, folder)), _tree(target_orders(spark, folder)))


_TAIL = 300  # the copy lacks every key from here on, so its tree is lower


@check(
    "agg12_missing_tail",
    f"""WITH {EDGE_SQL}, {_tree_sql('edge', 0)}, short AS (SELECT * FROM edge WHERE o_orderkey < {_TAIL}),
        n AS (SELECT {floor_div_sql('o_orderkey', _LEAF)} AS node, count(*) AS source_rows, count(*) FILTER (o_orderkey < {_TAIL}) AS target_rows FROM edge GROUP BY 1)
        SELECT CAST(node AS BIGINT) AS node, source_rows, target_rows FROM n WHERE source_rows <> target_rows""",
)
def missing_tail(spark, folder) -> DataFrame:
    source = edge_orders(spark, folder)
    trees = [merkle.merkle_tree(df, "o_orderkey", _LEAF, 4) for df in (source, source.where(F.col("o_orderkey") < _TAIL))]
    return merkle.merkle_diff(*trees)


@check(
    "agg11_ninth_decimal",
    """SELECT count(*) FILTER (o_orderkey % 50 = 0 AND o_totalprice + 1e-9 <> o_totalprice) AS differing_rows, count(*) AS n_rows FROM orders""",
)
def ninth_decimal(spark, folder) -> DataFrame:
    """Row fingerprints tell doubles apart that differ far behind the point, in the form other engines can repeat."""
    rows = table(spark, folder, "orders")
    moved = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + F.lit(1e-9)).otherwise(F.col("o_totalprice"))
    hashed = [
        df.select("o_orderkey", row_hash(df, "md5").alias("h")) for df in (rows, rows.withColumn("o_totalprice", moved))
    ]
    joined = hashed[0].join(hashed[1].withColumnRenamed("h", "other"), "o_orderkey")
    return joined.agg(F.count_if(F.col("h") != F.col("other")).alias("differing_rows"), F.count(F.lit(1)).alias("n_rows"))


@check(
    "joi11_text_key_repair",
    f"""WITH {EDGE_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS order_ref, o_custkey, o_orderstatus, o_orderpriority FROM edge""",
)
def text_key_repair(spark, folder) -> DataFrame:
    """A text key and another number of leaves than usual; the repair takes both from the trees."""
    source, target = (
        df.select(F.col("o_orderkey").cast("string").alias("order_ref"), "o_custkey", "o_orderstatus", "o_orderpriority")
        for df in (edge_orders(spark, folder), target_orders(spark, folder))
    )
    trees = [merkle.merkle_tree(df, "order_ref", leaves=500) for df in (source, target)]
    return merkle.repair(source, target, *trees)


@check(
    "agg13_divergence_pct",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, {_tree_sql('edge', 0)}, {_tree_sql('target', 0)}
        SELECT count(*) AS leaves, count(*) FILTER (a.digest IS DISTINCT FROM b.digest) AS dirty_leaves,
               round(CAST(count(*) FILTER (a.digest IS DISTINCT FROM b.digest) AS DOUBLE) / count(*) * 100, 6) AS divergence_pct
        FROM edge_0 a FULL OUTER JOIN target_0 b ON a.node = b.node""",
)
def divergence_pct(spark, folder) -> DataFrame:
    return merkle.divergence_pct(
        merkle.merkle_leaves(edge_orders(spark, folder), "o_orderkey", _LEAF),
        merkle.merkle_leaves(target_orders(spark, folder), "o_orderkey", _LEAF),
    )


@check(
    "joi11_block_repair",
    f"""WITH {EDGE_SQL} SELECT o_orderkey, o_custkey, o_orderstatus,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice, o_orderpriority FROM edge""",
)
def block_repair(spark, folder) -> DataFrame:
    """After the repair the target must equal the source, row for row."""
    source, target = edge_orders(spark, folder), target_orders(spark, folder)
    dirty = merkle.compare_nodes(
        merkle.merkle_leaves(source, "o_orderkey", _LEAF), merkle.merkle_leaves(target, "o_orderkey", _LEAF)
    )
    repaired = merkle.repair_blocks(source, target, dirty, "o_orderkey", _LEAF)
    return repaired.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("o_totalprice"), "o_orderpriority",
    )


@check(
    "agg31_row_parity",
    f"""WITH {EDGE_SQL}, {TARGET_SQL}, n AS (SELECT (SELECT count(*) FROM edge) AS s, (SELECT count(*) FROM target) AS t)
        SELECT s AS source_rows, t AS target_rows, round(CAST(abs(s - t) AS DOUBLE) / s * 100, 6) AS difference_pct,
               CAST(abs(s - t) AS DOUBLE) / s * 100 <= 0.001 AS passed FROM n""",
)
def row_parity(spark, folder) -> DataFrame:
    return snapshot.row_parity(edge_orders(spark, folder), target_orders(spark, folder))


@check(
    "srt5_key_order",
    """SELECT count(*) AS n_rows, CAST(count(*) FILTER (prev > k) AS BIGINT) AS out_of_order
       FROM (SELECT l_orderkey AS k, lag(l_orderkey) OVER (ORDER BY l_orderkey) AS prev FROM lineitem)""",
)
def key_order(spark, folder) -> DataFrame:
    """Neighbours out of order inside the sorted range partitions, and partitions out of order (there must be none)."""
    rows = table(spark, folder, "lineitem").select("l_orderkey")
    ordered = cut_lineage(
        snapshot_reads.in_key_order(rows, "l_orderkey").select("l_orderkey", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    )
    before = F.lag("l_orderkey").over(Window.partitionBy("p").orderBy("at"))
    inside = ordered.withColumn("wrong", (before > F.col("l_orderkey")).cast("int"))
    ends = inside.groupBy("p").agg(
        F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong")
    )
    between = (F.lag("last").over(Window.orderBy("p")) > F.col("first")).cast("int")  # one row a partition
    return ends.withColumn("between", F.coalesce(between, F.lit(0))).agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("wrong") + F.col("between")).alias("out_of_order")
    )
