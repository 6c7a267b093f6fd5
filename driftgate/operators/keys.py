"""Foreign keys: orphans, dependency order, topological levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.session import cut_lineage


@dataclass(frozen=True)
class ForeignKey:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    constraint: str


def orphan_values(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent, and how many rows have each.

    The child is first reduced to distinct values with counts (map-side), so a
    value a third of all rows share is one row by the time it is joined.
    """
    values = child.where(F.col(child_column).isNotNull()).groupBy(F.col(child_column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    parents = parent.select(F.col(parent_column).alias("_parent"))
    return values.join(parents, F.col("value") == F.col("_parent"), "left_anti")


def fk_check(tables: dict[str, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """Orphan rows per constraint; a constraint passes with none.

    A constraint on a table that is not there fails instead of passing silently.
    """
    parts = []
    for key in keys:
        named = F.lit(key.constraint).alias("constraint")
        if key.from_table not in tables or key.to_table not in tables:
            spark = next(iter(tables.values())).sparkSession
            parts.append(
                spark.range(1).select(named, F.lit(None).cast("bigint").alias("orphans"), F.lit(False).alias("passed"))
            )
            continue
        lost = orphan_values(tables[key.from_table], key.from_column, tables[key.to_table], key.to_column)
        rows = F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint")
        parts.append(lost.agg(rows.alias("orphans")).select(named, "orphans", (F.col("orphans") == 0).alias("passed")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def fk_levels(edges: DataFrame, tables: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """Processing level per table: parents before children, longest path counts.

    ``edges`` has from_table (child) and to_table (parent). Every round settles
    the tables whose parents are all settled and takes their edges away; each
    round's small remainder is checkpointed. Tables on a cycle, or below one, are
    never settled and come back with a null level; ``fk_order`` has one for them too. References of a table to itself
    are left out. Tables without edges get level 0. There are as many rounds as
    levels; if ``max_rounds`` does not suffice, that is an error and no cycle.
    """
    pairs = _pairs(edges)
    nodes = edges.select(F.col("from_table").alias("table_name")).unionByName(
        edges.select(F.col("to_table").alias("table_name"))
    )
    if tables is not None:
        nodes = nodes.unionByName(tables.select("table_name"))
    nodes = cut_lineage(nodes.distinct())
    left = cut_lineage(pairs)
    waiting = nodes
    settled: DataFrame | None = None
    for level in count():
        children = left.select(F.col("from_table").alias("table_name")).distinct()
        ready = waiting.join(children, "table_name", "left_anti").withColumn("level", F.lit(level))
        ready = cut_lineage(ready)
        if ready.isEmpty():
            break
        if max_rounds is not None and level >= max_rounds:
            raise ValueError(f"the references are more than {max_rounds} levels deep")
        settled = ready if settled is None else settled.unionByName(ready)
        done = ready.select(F.col("table_name").alias("to_table"))
        left = cut_lineage(left.join(done, "to_table", "left_anti"))
        waiting = cut_lineage(waiting.join(ready, "table_name", "left_anti"))
    if settled is None:
        return nodes.withColumn("level", F.lit(None).cast("int"))
    return nodes.join(settled, "table_name", "left")


def cycles(edges: DataFrame) -> DataFrame:
    """(table_name, component) of the tables on cycles: component is the smallest table that can reach and be reached.

    ``edges`` has from_table and to_table. Round by round, tables without a way in or without a way out are trimmed, as no
    cycle passes through them. Of what is left each table learns the smallest table that reaches it; from a table that
    learned itself, the search goes backward among those that learned the same, and finds its component. Components are
    taken out and the rest starts anew. Every step is a join and a minimum over the edges, combined before the shuffle;
    steps grow with the longest way inside what is left. References of a table to itself are left out.
    """
    left = cut_lineage(_pairs(edges))
    found: DataFrame | None = None
    while not (left := _trimmed(left)).isEmpty():
        names = left.select(F.col("from_table").alias("table_name")).distinct()
        seen = cut_lineage(names.withColumn("label", F.col("table_name")))
        before = None
        while (now := tuple(seen.agg(F.sum(F.xxhash64("table_name", "label").cast("decimal(38,0)"))).first())) != before:
            before = now
            reached = left.join(seen.withColumnRenamed("table_name", "from_table"), "from_table").groupBy(F.col("to_table").alias("table_name")).agg(F.min("label").alias("_from"))
            seen = cut_lineage(seen.join(reached, "table_name", "left").select("table_name", F.least("label", F.coalesce("_from", "label")).alias("label")))
        inside = left.join(seen.select(F.col("table_name").alias("from_table"), F.col("label").alias("a")), "from_table")
        inside = inside.join(seen.select(F.col("table_name").alias("to_table"), F.col("label").alias("b")), "to_table").where("a = b")
        inside = cut_lineage(inside.select("from_table", "to_table"))
        members = cut_lineage(seen.where("table_name = label"))
        fresh = members
        while not fresh.isEmpty():  # backward from the roots
            step = inside.join(fresh.withColumnRenamed("table_name", "to_table"), "to_table").select(F.col("from_table").alias("table_name"), "label").distinct()
            fresh = cut_lineage(step.join(members.select("table_name"), "table_name", "left_anti"))
            members = cut_lineage(members.unionByName(fresh))
        done = members.withColumnRenamed("label", "component")
        found = done if found is None else found.unionByName(done)
        out = members.select("table_name")
        left = left.join(out.withColumnRenamed("table_name", "from_table"), "from_table", "left_anti")
        left = cut_lineage(left.join(out.withColumnRenamed("table_name", "to_table"), "to_table", "left_anti"))
    if found is None:
        return edges.select(F.col("from_table").alias("table_name"), F.col("from_table").alias("component")).limit(0)
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(found.join(size, "component").select("table_name", "component"))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("from_table") != F.col("to_table")).select("from_table", "to_table").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Only the edges whose both ends have a way in and a way out."""
    left, n = edges, -1
    while (now := left.count()) != n:
        n = now
        targets = left.select(F.col("to_table").alias("from_table")).distinct()
        sources = left.select(F.col("from_table").alias("to_table")).distinct()
        left = cut_lineage(left.join(targets, "from_table", "left_semi").join(sources, "to_table", "left_semi"))
    return left


def fk_order(edges: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(table_name, level, component, cyclic): a level for every table, those on cycles and below them included.

    Tables that refer to each other in a circle form a component, named after its smallest table, and are processed
    together; a component comes after the components it refers to, by the longest way. Any other table is a component of
    its own. Levels are those of ``fk_levels`` where there are no cycles.
    """
    looped = cycles(edges)
    named = looped.select(F.col("table_name").alias("from_table"), F.col("component").alias("a"))
    joined = _pairs(edges).join(named, "from_table", "left")
    joined = joined.join(looped.select(F.col("table_name").alias("to_table"), F.col("component").alias("b")), "to_table", "left")
    between = joined.select(F.coalesce("a", "from_table").alias("from_table"), F.coalesce("b", "to_table").alias("to_table"))
    nodes = edges.select(F.col("from_table").alias("table_name")).unionByName(edges.select(F.col("to_table").alias("table_name")))
    if tables is not None:
        nodes = nodes.unionByName(tables.select("table_name"))
    placed = nodes.distinct().join(looped, "table_name", "left").select("table_name", F.coalesce("component", "table_name").alias("component"), F.col("component").isNotNull().alias("cyclic"))
    placed = cut_lineage(placed)
    levels = fk_levels(between, placed.select(F.col("component").alias("table_name")).distinct())
    return placed.join(levels.withColumnRenamed("table_name", "component"), "component").select("table_name", "level", "component", "cyclic")


def processing_order(levels: DataFrame) -> DataFrame:
    """Tables in processing order; cyclic ones last."""
    return levels.orderBy(F.col("level").asc_nulls_last(), "table_name")
