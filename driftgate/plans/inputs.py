"""Inputs of the checks, each derived from the given tables twice: in Spark and in SQL.

The derivations inject the defects (missing rows, changed values, duplicate
deliveries, stale epochs) that the operators have to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.plans.registry import table

# --- source and target copies of orders ------------------------------------

EDGE_SQL = """edge AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""
TARGET_SQL = """target AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT -(o_orderkey + 1), o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 1009 = 0)"""
TOUCHED_SQL = """touched AS (
  SELECT k AS o_orderkey, CASE WHEN k % 7 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation,
         CAST(1 + abs(k) % 20 AS DOUBLE) AS edge_ms,
         CAST((1 + abs(k) % 20) * (1 + abs(k) % 3) AS DOUBLE) AS target_ms
  FROM (SELECT o_orderkey AS k FROM orders
        UNION ALL SELECT -(o_orderkey + 1) FROM orders WHERE o_orderkey % 1009 = 0))"""


def edge_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    return rows.withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 83 != 0, F.col("o_orderpriority"))
    )


def target_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    kept = rows.where(key % 97 != 0).select(
        "o_orderkey", "o_custkey",
        F.when(key % 89 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", "o_orderdate",
        F.when(key % 83 == 0, "").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    extra = rows.where(key % 1009 == 0).withColumn("o_orderkey", -(key + 1))
    return kept.unionByName(extra)


def touched_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    keys = rows.unionByName(rows.where(key % 1009 == 0).select((-(key + 1)).alias("o_orderkey")))
    spread = F.abs(key)
    return keys.select(
        "o_orderkey",
        F.when(key % 7 == 0, "DELETE").otherwise("UPDATE").alias("operation"),
        (1 + spread % 20).cast("double").alias("edge_ms"),
        ((1 + spread % 20) * (1 + spread % 3)).cast("double").alias("target_ms"),
    )


def canonical_sql(columns: dict[str, str]) -> str:
    """SQL for the canonical JSON text of a row; values are SQL texts by column name."""
    parts = [
        f"""'"{name}":' || coalesce('"' || {text} || '"', 'null')""" for name, text in sorted(columns.items())
    ]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def double_text_sql(x: str) -> str:
    """SQL for the lossless text of a double: sign, mantissa, power of two."""
    near = f"floor(log2(abs({x})))"
    power = f"(CASE WHEN pow(2.0::DOUBLE, {near}) > abs({x}) THEN {near} - 1 WHEN pow(2.0::DOUBLE, {near} + 1) <= abs({x}) THEN {near} + 1 ELSE {near} END)"
    mantissa = f"CAST(abs({x}) / pow(2.0::DOUBLE, {power}) * 4503599627370496.0::DOUBLE AS BIGINT)"
    return f"(CASE WHEN {x} = 0 THEN '0' ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '' END) || {mantissa} || 'p' || CAST({power} AS BIGINT) END)"


ORDERS_TEXT = canonical_sql(
    {
        "o_orderkey": "CAST(o_orderkey AS VARCHAR)",
        "o_custkey": "CAST(o_custkey AS VARCHAR)",
        "o_orderstatus": "o_orderstatus",
        "o_totalprice": double_text_sql("o_totalprice"),
        "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')",
        "o_orderpriority": "o_orderpriority",
    }
)


def hex_number_sql(text: str, start: int, digits: int) -> str:
    return f"('0x' || substr({text}, {start}, {digits}))::BIGINT"


def uniform_sql(key: str) -> str:
    return f"({hex_number_sql(f'md5({key})', 1, 13)} / pow(2, 52))"


def normal_sql(key: str) -> str:
    first = f"(({hex_number_sql(f'md5({key})', 1, 13)} + 0.5::DOUBLE) / pow(2, 52))"
    second = f"({hex_number_sql(f'md5({key})', 14, 13)} / pow(2, 52))"
    return f"(sqrt(-2.0::DOUBLE * ln({first})) * cos(6.283185307179586::DOUBLE * {second}))"


def floor_div_sql(value: str, width: int) -> str:
    return f"(({value}) - ((({value}) % {width}) + {width}) % {width}) // {width}"
