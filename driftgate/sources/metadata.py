"""What a database holds: tables, columns, indexes, keys, sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgate.functions.pii import pii_tier
from driftgate.functions.rows import row_bytes
from driftgate.operators.keys import ForeignKey

_CATALOG_VIEWS = {
    "tables": "TABLES", "columns": "COLUMNS", "indexes": "STATISTICS", "keys": "KEY_COLUMN_USAGE",
    "triggers": "TRIGGERS", "routines": "ROUTINES", "views": "VIEWS",
}
_SCHEMA_COLUMN = {"TRIGGERS": "TRIGGER_SCHEMA", "ROUTINES": "ROUTINE_SCHEMA"}


def scan_jdbc_metadata(spark: SparkSession, url: str, database: str, **options) -> dict[str, DataFrame]:
    """One read per catalog view, filtered at the source; no query per table."""
    found = {}
    for name, view in _CATALOG_VIEWS.items():
        column = _SCHEMA_COLUMN.get(view, "TABLE_SCHEMA")
        query = f"SELECT * FROM information_schema.{view} WHERE {column} = '{database}'"
        found[name] = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return found


def table_facts(catalog_tables: DataFrame) -> DataFrame:
    """Base tables with their estimates; missing figures are 0, a missing engine InnoDB."""
    def figure(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    return catalog_tables.where("TABLE_TYPE = 'BASE TABLE'").select(
        F.col("TABLE_NAME").alias("table_name"), F.coalesce("ENGINE", F.lit("InnoDB")).alias("engine"),
        figure("TABLE_ROWS").alias("row_count"), figure("DATA_LENGTH").alias("data_bytes"),
        figure("INDEX_LENGTH").alias("index_bytes"), figure("AVG_ROW_LENGTH").alias("avg_row_bytes"),
    )


def column_facts(catalog_columns: DataFrame) -> DataFrame:
    return catalog_columns.select(
        F.col("TABLE_NAME").alias("table_name"), F.col("COLUMN_NAME").alias("column_name"),
        F.col("ORDINAL_POSITION").cast("int").alias("ordinal"), F.col("DATA_TYPE").alias("data_type"),
        (F.col("IS_NULLABLE") == "YES").alias("is_nullable"),
        F.col("CHARACTER_MAXIMUM_LENGTH").cast("bigint").alias("max_length"),
        F.coalesce("COLUMN_KEY", F.lit("")).alias("column_key"),
    )


def indexes(index_columns: DataFrame) -> DataFrame:
    """Ordered column list per index from (table_name, index_name, seq, column_name, non_unique, index_type)."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "column_name"))), lambda c: c["column_name"])
    return index_columns.groupBy("table_name", "index_name").agg(
        listed.alias("columns"), (F.min("non_unique") == 0).alias("is_unique"), F.first("index_type").alias("index_type")
    )


def fk_edges(spark: SparkSession, keys: Sequence[ForeignKey]) -> DataFrame:
    rows = [(k.from_table, k.from_column, k.to_table, k.to_column, k.constraint) for k in keys]
    return spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string, constraint string")


def fk_edges_from_catalog(key_usage: DataFrame) -> DataFrame:
    return key_usage.where("REFERENCED_TABLE_NAME is not null").select(
        F.col("TABLE_NAME").alias("from_table"), F.col("COLUMN_NAME").alias("from_column"),
        F.col("REFERENCED_TABLE_NAME").alias("to_table"), F.col("REFERENCED_COLUMN_NAME").alias("to_column"),
        F.col("CONSTRAINT_NAME").alias("constraint"),
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact rows, bytes and mean row size per table, one pass each."""
    parts = []
    for name, df in tables.items():
        sized = df.select(row_bytes(df).alias("_b"))
        parts.append(
            sized.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.coalesce(F.sum("_b"), F.lit(0)).alias("data_bytes"),
                F.round(F.coalesce(F.avg("_b"), F.lit(0.0)), 2).alias("avg_row_bytes"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    return _union(parts)


def profile_columns(tables: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """Per column: position, type, nulls, longest text; with ``approximate`` also distinct values.

    One aggregate per table over all its columns, then unpivoted.
    """
    parts = []
    for name, df in tables.items():
        figures = []
        for position, field in enumerate(df.schema.fields, start=1):
            column = F.col(f"`{field.name}`")
            longest = F.max(F.length(column)) if isinstance(field.dataType, T.StringType) else F.lit(None)
            distinct = F.approx_count_distinct(column) if approximate else F.lit(None)
            figures.append(
                F.struct(
                    F.lit(field.name).alias("column_name"), F.lit(position).alias("ordinal"),
                    F.lit(field.dataType.simpleString()).alias("data_type"),
                    (F.count(F.lit(1)) - F.count(column)).alias("null_count"),
                    longest.cast("bigint").alias("max_length"), distinct.cast("bigint").alias("distinct_values"),
                )
            )
        one = df.agg(F.array(*figures).alias("_c"))
        parts.append(one.select(F.lit(name).alias("table_name"), F.explode("_c").alias("_c")).select("table_name", "_c.*"))
    return _union(parts)


def classify_columns(columns: DataFrame, match: str = "substring") -> DataFrame:
    """Add the personal-data tier to column facts (column_name, data_type, max_length)."""
    return columns.withColumn(
        "pii_tier", pii_tier(F.col("column_name"), F.col("data_type"), F.col("max_length"), match)
    )


def pii_map(classified: DataFrame) -> DataFrame:
    """Sensitive columns per table; tables without any are left out."""
    found = F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type", "pii_tier")))
    return classified.where("pii_tier is not null").groupBy("table_name").agg(
        F.transform(
            found,
            lambda c: F.struct(c["column_name"].alias("column"), c["data_type"].alias("type"), c["pii_tier"].alias("pii_tier")),
        ).alias("columns")
    )


def inventory(tables: DataFrame, columns: DataFrame, index_list: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested row per table: facts, ordered columns, indexes and foreign keys."""
    ordered = columns.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type"))).alias("columns")
    )
    listed = index_list.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("index_name", "columns"))).alias("indexes")
    )
    keys = edges.groupBy(F.col("from_table").alias("table_name")).agg(
        F.sort_array(F.collect_list(F.struct("constraint", "from_column", "to_table", "to_column"))).alias("foreign_keys")
    )
    return tables.join(ordered, "table_name", "left").join(listed, "table_name", "left").join(keys, "table_name", "left")


def inventory_totals(tables: DataFrame) -> DataFrame:
    return tables.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("data_bytes"), F.lit(0)).alias("total_data_bytes"),
        F.coalesce(F.sum("index_bytes"), F.lit(0)).alias("total_index_bytes"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
    )


def largest_first(tables: DataFrame) -> DataFrame:
    """Position of each table by size, largest first (a handful of rows per schema)."""
    order = Window.orderBy(F.desc("data_bytes"), F.asc("table_name"))
    return tables.withColumn("position", F.row_number().over(order))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
