"""Hash trees over key ranges: build, compare from the root down, repair what differs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgate.functions.rows import row_hash
from driftgate.operators.snapshot import fingerprint
from driftgate.session import cut_lineage
from driftgate.sources.snapshot_reads import slot_of

LEAF_ROWS = 4096
FANOUT = 16
_HASH_LEAVES = 1 << 20


@dataclass(frozen=True)
class LeafRule:
    """How rows are dealt to leaves; both trees of a comparison and the repair must use the same."""

    pk: str | tuple[str, ...]
    leaf_rows: int = LEAF_ROWS
    leaves: int = _HASH_LEAVES
    fanout: int = FANOUT


class MerkleTree(list):
    """Levels from the leaves up to the single root, with the rule they were made by."""

    def __init__(self, levels: list[DataFrame], rule: LeafRule):
        super().__init__(levels)
        self.rule = rule


def leaf_of(df: DataFrame, pk: str | Sequence[str], leaf_rows: int = LEAF_ROWS, leaves: int = _HASH_LEAVES) -> Column:
    """Leaf number of each row: a key range, or a hash bucket for other kinds of key."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.IntegralType):
        return slot_of(F.col(keys[0]), leaf_rows)
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("bigint")


def merkle_leaves(
    df: DataFrame, pk, leaf_rows: int = LEAF_ROWS, method: str = "xxhash64", leaves: int = _HASH_LEAVES
) -> DataFrame:
    """Digest per leaf: (node, row_count, digest). One pass, one small shuffle."""
    hashed = df.select(leaf_of(df, pk, leaf_rows, leaves).alias("node"), row_hash(df, method).alias("_h"))
    grouped = hashed.groupBy("node").agg(*fingerprint(F.col("_h")))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("row_count", "xor_hash", "sum_high", "sum_low")])
    return grouped.select("node", "row_count", F.sha2(text, 256).alias("digest"))


def merkle_build(leaves: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> list[DataFrame]:
    """Levels of the tree from the leaves up; the last level is the single root.

    A parent hashes its children in order; at most ``fanout`` of them, so no
    group can grow. Keep ``leaves`` as a table (or a checkpoint) when the tree is
    used more than once: then only leaves touched since need recomputing.
    """
    if levels is None:
        widest = leaves.agg(F.max(F.abs("node"))).first()[0] or 0
        levels = 1
        while fanout**levels <= widest:
            levels += 1
    built = [leaves]
    for _ in range(levels):
        built.append(_parents(built[-1], slot_of(F.col("node"), fanout)))
    # negative keys leave at most two nodes here
    built.append(_parents(built[-1], F.lit(0).cast("bigint")))
    return built


def _parents(children: DataFrame, parent: Column) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("node", "digest")))
    grouped = children.groupBy(parent.alias("_parent")).agg(
        F.sum("row_count").alias("row_count"), listed.alias("_children")
    )
    digest = F.sha2(F.array_join(F.transform("_children", lambda c: c["digest"]), ","), 256)
    return grouped.select(F.col("_parent").alias("node"), "row_count", digest.alias("digest"))


def merkle_tree(
    df: DataFrame, pk, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT, method: str = "xxhash64", leaves: int = _HASH_LEAVES
) -> MerkleTree:
    """Tree of a table whose leaves are cut from their lineage, so the table is read once."""
    rule = LeafRule(pk if isinstance(pk, str) else tuple(pk), leaf_rows, leaves, fanout)
    return MerkleTree(merkle_build(cut_lineage(merkle_leaves(df, pk, leaf_rows, method, leaves)), fanout), rule)


def _same_height(a: list[DataFrame], b: list[DataFrame], fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Both trees with as many levels as the higher one: the other gets further parents below its root."""
    rules = {t.rule for t in (a, b) if isinstance(t, MerkleTree)}
    if len(rules) > 1:
        raise ValueError("the trees deal rows to leaves by different rules")

    def grown(tree: list[DataFrame], levels: int) -> list[DataFrame]:
        if len(tree) == levels:
            return list(tree)
        inner = list(tree[:-1])
        while len(inner) < levels - 1:
            inner.append(_parents(inner[-1], slot_of(F.col("node"), fanout)))
        return [*inner, _parents(inner[-1], F.lit(0).cast("bigint"))]

    levels = max(len(a), len(b))
    return grown(a, levels), grown(b, levels)


def merkle_diff(
    a: list[DataFrame], b: list[DataFrame], fanout: int | None = None, through: tuple[int, ...] = (2,)
) -> DataFrame:
    """Leaves that differ: (node, source_rows, target_rows), found from above.

    ``through`` names the levels compared before the leaves, highest first; only
    what lies below a differing node is looked at next. One level of 256 leaves a
    node prunes nearly as well as all of them and costs one join instead of many;
    name more when the levels are stored tables. Trees may differ in height, as
    when one side lacks the end of the table. The fan-out is that of the trees,
    and has to be given for plain lists of levels with another than the default.
    """
    fanout = fanout or _fanout(a, b)
    a, b = _same_height(a, b, fanout)
    dirty: DataFrame | None = None
    above = 0
    for level in [*[n for n in through if 0 < n < len(a) - 1], 0]:
        left, right = a[level], b[level]
        if dirty is not None:
            parent = slot_of(F.col("node"), fanout ** (above - level))
            left, right = _below(left, parent, dirty), _below(right, parent, dirty)
        dirty, above = compare_nodes(left, right), level
    return dirty


def _fanout(*trees: list[DataFrame]) -> int:
    return next((t.rule.fanout for t in trees if isinstance(t, MerkleTree)), FANOUT)


def roots_match(a: list[DataFrame], b: list[DataFrame], fanout: int | None = None) -> DataFrame:
    """One row: whether the two trees have the same root."""
    a, b = _same_height(a, b, fanout or _fanout(a, b))
    return compare_nodes(a[-1], b[-1]).agg((F.count(F.lit(1)) == 0).alias("roots_match"))


def _below(nodes: DataFrame, parent: Column, dirty: DataFrame) -> DataFrame:
    wanted = dirty.select(F.col("node").alias("_wanted"))
    return nodes.withColumn("_up", parent).join(wanted, F.col("_up") == F.col("_wanted"), "left_semi").drop("_up")


def compare_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of one level whose digests differ or that exist on one side only."""
    left = a.select("node", F.col("row_count").alias("source_rows"), F.col("digest").alias("_a"))
    right = b.select("node", F.col("row_count").alias("target_rows"), F.col("digest").alias("_b"))
    joined = left.join(right, "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select(
        "node",
        F.coalesce("source_rows", F.lit(0)).cast("bigint").alias("source_rows"),
        F.coalesce("target_rows", F.lit(0)).cast("bigint").alias("target_rows"),
    )


def divergence_pct(source_leaves: DataFrame, target_leaves: DataFrame) -> DataFrame:
    """Share of leaves that differ, in percent."""
    left = source_leaves.select("node", F.col("digest").alias("_a"))
    right = target_leaves.select("node", F.col("digest").alias("_b"))
    counted = left.join(right, "node", "full_outer").agg(
        F.count(F.lit(1)).alias("leaves"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("dirty_leaves"),
    )
    pct = F.coalesce(F.try_divide(F.col("dirty_leaves"), F.col("leaves")) * 100, F.lit(0.0))
    return counted.select("leaves", "dirty_leaves", F.round(pct, 6).alias("divergence_pct"))


def repair_blocks(
    source: DataFrame, target: DataFrame, dirty: DataFrame, pk, leaf_rows: int = LEAF_ROWS, leaves: int = _HASH_LEAVES
) -> DataFrame:
    """Target with every differing leaf replaced by the source's rows of that leaf.

    ``leaf_rows`` and ``leaves`` are those the leaves were made with; ``repair`` takes them from the trees.
    """
    wanted = dirty.select(F.col("node").alias("_wanted"))
    fresh = source.withColumn("_leaf", leaf_of(source, pk, leaf_rows, leaves)).join(
        wanted, F.col("_leaf") == F.col("_wanted"), "left_semi"
    )
    kept = target.withColumn("_leaf", leaf_of(target, pk, leaf_rows, leaves)).join(
        wanted, F.col("_leaf") == F.col("_wanted"), "left_anti"
    )
    return kept.drop("_leaf").unionByName(fresh.drop("_leaf"))


def repair(source: DataFrame, target: DataFrame, source_tree: MerkleTree, target_tree: MerkleTree) -> DataFrame:
    """Target with every leaf in which the trees differ replaced by the source's rows."""
    rule = source_tree.rule
    return repair_blocks(source, target, merkle_diff(source_tree, target_tree), rule.pk, rule.leaf_rows, rule.leaves)
