"""A trie of conversations: by digests of whole blocks of turns first, turn by turn only where siblings diverge.

A conversation's first d turns are known by a digest of two 64-bit numbers, the exclusive or of one number for each turn,
which hashes the turn's place together with the SHA-256 of its role and text. Digests of all prefixes are then one running
aggregate over rows without texts, and the prefix before a block is the digest after it without the block's turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import kept
from driftgate.operators.prefix import add_order_ranges, running_scan

BLOCK = 8  # turns
_LONG = 8192  # places of one conversation that a window holds
_HEAD = 9  # turns taken from another conversation: fewer than this
_CHUNK = 1 << 14  # ids that are joined to one text


def _along(rows: DataFrame, place: str, measures: dict[str, tuple[Callable[[Column], Column], str]], downward: bool = False) -> DataFrame:
    """Running aggregates along each conversation's places, up or down, in windows of at most ``_LONG`` places.

    A conversation of more is cut, and what its earlier cuts amount to (a row a cut) is added to the later ones.
    """
    rows = rows.withColumn("_cut", F.floor(F.col(place) / _LONG))
    order, cut_order = (F.desc(place), F.desc("_cut")) if downward else (F.asc(place), F.asc("_cut"))
    local = Window.partitionBy("conv_id", "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy(cut_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "_cut").agg(*[f(F.col(c)).alias(f"_of_{n}") for n, (f, c) in measures.items()])
    carried = totals.select("conv_id", "_cut", *[f(F.col(f"_of_{n}")).over(earlier).alias(f"_from_{n}") for n, (f, _) in measures.items()])
    carried = carried.where(F.coalesce(*[F.col(f"_from_{n}") for n in measures]).isNotNull())
    found = rows.select("*", *[f(F.col(c)).over(local).alias(f"_here_{n}") for n, (f, c) in measures.items()]).join(carried, ["conv_id", "_cut"], "left")
    for n, (f, _) in measures.items():
        base = F.coalesce(F.col(f"_from_{n}"), F.lit(0).cast("bigint"))
        found = found.withColumn(n, F.col(f"_here_{n}").bitwiseXOR(base) if f is F.bit_xor else F.col(f"_here_{n}") + base)
    return found.drop("_cut", *[f"{p}_{n}" for n in measures for p in ("_here", "_from")])


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations with shared beginnings: (conv_id, size) of all, and (conv_id, place, bytes, a, b) of their turns.

    Conversation c begins with the first h original turns of conversation c - c % 5 (all, if it has fewer; none, if it is
    not there) and goes on with its own turns after its own first h, where h is crc32 of c in decimal, modulo 9. Turns are
    ordered by number, null first; equal numbers by the digest of role and text. Null role or text counts as empty. Rows
    with a null conv_id belong to no conversation; repeated rows are turns of their own.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(told[0]).cast("string"), F.lit(":"), *told).cast("binary"), 256)).alias("digest"),
        F.octet_length(told[1]).cast("bigint").alias("bytes"),
    )
    # a conversation may be very long, so its turns are numbered by ranges of the whole order
    order = ["conv_id", "turn", "digest"]
    own = kept(running_scan(rows, order, {"place": ("count", F.lit(1))}, keys=["conv_id"]).selectExpr("conv_id", "place - 1 AS place", "digest", "bytes"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % _HEAD
    base = F.col("conv_id") - F.col("conv_id") % 5
    heads = (
        own.where(F.col("conv_id") % 5 == 0)
        .where(F.col("place") < _HEAD - 1)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("head"))
    )
    every = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).withColumns({"h": head, "base": base}).join(heads, "base", "left")
    taken = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("bigint"))
    taken = F.when(F.col("head").isNull(), F.lit(0).cast("bigint")).otherwise(taken)
    every = kept(
        every.withColumn("taken", taken).select(
            "conv_id", "h", "taken", F.slice("head", F.lit(1), F.col("taken").cast("int")).alias("head"), (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("size")
        )
    )
    begun = every.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.place", "t.digest", "t.bytes")
    rest = own.join(every.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    turns = begun.unionByName(rest.select("conv_id", F.expr("place - h + taken").alias("place"), "digest", "bytes"))
    numbers = [F.xxhash64(F.lit(seed), "place", "digest").alias(name) for seed, name in ((1, "a"), (2, "b"))]
    return every.select("conv_id", "size"), turns.select("conv_id", "place", "bytes", *numbers)


def _nodes(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, digest a b, digest of the parent pa pb, bytes, n_convs, conv_id) below the root, and (conv_id, depth, a, b) where each ends."""
    prefixed = kept(
        _along(turns.withColumnRenamed("a", "ta").withColumnRenamed("b", "tb"), "place", {"a": (F.bit_xor, "ta"), "b": (F.bit_xor, "tb")})
        .join(sizes, "conv_id")
        .withColumn("block", F.floor(F.col("place") / BLOCK))
    )
    ends = prefixed.where("place = size - 1").select("conv_id", F.col("size").alias("depth"), "a", "b")
    ends = ends.unionByName(sizes.where("size = 0").selectExpr("conv_id", "size AS depth", "0L AS a", "0L AS b"))
    # a block of one conversation: at most BLOCK turns, known by the digest after its last one
    step = F.struct("place", "bytes", "a", "b", "ta", "tb")
    blocks = prefixed.groupBy("conv_id", "block").agg(
        F.max_by("a", "place").alias("a"), F.max_by("b", "place").alias("b"), F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"), F.sort_array(F.collect_list(step)).alias("steps")
    )
    # conversations with the same turns up to the end of a block go on as one
    groups = kept(blocks.groupBy("block", "a", "b", "xa", "xb").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("steps").alias("steps")))
    groups = groups.withColumns({"pa": F.col("a").bitwiseXOR(F.col("xa")), "pb": F.col("b").bitwiseXOR(F.col("xb"))})
    only = groups.groupBy("block", "pa", "pb").agg(F.count(F.lit(1)).alias("siblings"), F.min("a").alias("a"), F.min("b").alias("b")).where("siblings = 1")
    groups = groups.join(only.select("block", "a", "b", F.lit(True).alias("alone")), ["block", "a", "b"], "left")
    inside = groups.select("alone", "n_convs", "conv_id", F.explode("steps").alias("t")).select(
        "alone",
        "n_convs",
        "conv_id",
        (F.col("t.place") + 1).alias("depth"),
        "t.bytes",
        "t.a",
        "t.b",
        F.col("t.a").bitwiseXOR(F.col("t.ta")).alias("pa"),
        F.col("t.b").bitwiseXOR(F.col("t.tb")).alias("pb"),
    )
    # without siblings all turns of the block have the members of its end; where siblings diverge, turns are counted one by one
    straight = inside.where("alone").drop("alone")
    key = ["depth", "a", "b", "pa", "pb", "bytes"]
    parted = inside.where("alone is null").groupBy(*key).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return straight.unionByName(parted), ends


def _joined_ids(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the ids of each node's own members, ascending, joined by commas.

    Ids are joined to texts of bounded length in ranges of the whole order first. A digest must read its node's texts one
    after another, but only these few, and holds one of them at a time.
    """
    order = ["depth", "a", "b", "conv_id"]
    dealt = add_order_ranges(ends.select(*order), order).select(*order, "_range").sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids = None, None, []

        def out() -> pa.RecordBatch:
            row = {"depth": [key[0]], "a": [key[1]], "b": [key[2]], "first": [first], "ids": [",".join(map(str, ids))]}
            return pa.RecordBatch.from_pydict(row, pa.schema([(c, pa.int64()) for c in ("depth", "a", "b", "first")] + [("ids", pa.string())]))

        for batch in batches:
            for *at, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != key or len(ids) == _CHUNK:
                    if ids:
                        yield out()
                    key, first, ids = at, conv, []
                ids.append(conv)
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def out() -> pa.RecordBatch:
            row = {"depth": [key[0]], "a": [key[1]], "b": [key[2]], "ends_sha256": [sha.hexdigest()]}
            return pa.RecordBatch.from_pydict(row, pa.schema([(c, pa.int64()) for c in ("depth", "a", "b")] + [("ends_sha256", pa.string())]))

        for batch in batches:
            for *at, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if at == key:
                    sha.update(b",")
                else:
                    if key:
                        yield out()
                    key, sha = at, hashlib.sha256()
                sha.update(ids.encode())
        if key:
            yield out()

    texts = dealt.mapInArrow(chunks, "depth bigint, a bigint, b bigint, first bigint, ids string")
    texts = texts.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first")
    return texts.mapInArrow(digests, "depth bigint, a bigint, b bigint, ends_sha256 string")


def _subtrees(paths: DataFrame) -> DataFrame:
    """(conv_id, saved, leaves) summed over all paths that hang from a path, itself included.

    ``paths`` has conv_id, up (the path it hangs from, null for the root's) and its own saved and leaves. After round k a
    path holds the sums of those fewer than 2^k steps below it and knows the one 2^k steps above, so the rounds grow with
    the logarithm of the height.
    """
    now = kept(paths)
    while not now.where("up is not null").isEmpty():
        given = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("n"))
        above = now.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        summed = now.join(given, "conv_id", "left").select(
            "conv_id", "up", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("n", F.lit(0))).alias("leaves")
        )
        now = kept(summed.join(above, "up", "left").select("conv_id", F.col("next").alias("up"), "saved", "leaves"))
    return now.select("conv_id", "saved", "leaves")


def trie(sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sizes`` (conv_id, size) has every conversation once and ``turns`` (conv_id, place, bytes, a, b) its turns at places 0
    to size - 1. A node is named by its depth and its smallest member. All conversations are members of the root, those
    without turns end there; without conversations there are no rows.

    The nodes of one smallest member lie on one path down to that conversation's end, and each path hangs from a node of
    another: subtree sums are taken over paths, then along them.
    """
    below, ends = _nodes(turns, sizes)
    root = sizes.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "a", "b", "bytes")]
    none = [F.lit(None).cast("bigint").alias(c) for c in ("pa", "pb")]
    nodes = kept(below.unionByName(root.select("n_convs", "conv_id", *zero, *none)).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum("saved").alias("saved"), F.min_by(F.struct("pa", "pb"), "depth").alias("p"))
    hung = tops.where("top > 0").select("conv_id", "end", "saved", (F.col("top") - 1).alias("depth"), F.col("p.pa").alias("a"), F.col("p.pb").alias("b"))
    hung = kept(hung.join(nodes.select("depth", "a", "b", F.col("conv_id").alias("up")), ["depth", "a", "b"]).select("conv_id", "up", "depth", "end", "saved"))
    first = tops.where("top = 0").select("conv_id", F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("bigint").alias("depth"), "end", "saved")
    paths = hung.unionByName(first)
    holds = hung.groupBy(F.col("up").alias("conv_id"), F.col("depth").alias("end")).agg(F.lit(0).cast("bigint").alias("leaves"))
    paths = paths.join(holds, ["conv_id", "end"], "left").select("conv_id", "up", "saved", F.coalesce("leaves", F.lit(1).cast("bigint")).alias("leaves"))
    sums = _subtrees(paths).withColumnRenamed("saved", "hung_saved").withColumnRenamed("leaves", "hung_leaves")
    branches = (
        hung.select("conv_id", "up", "depth")
        .join(sums, "conv_id")
        .groupBy(F.col("up").alias("conv_id"), "depth")
        .agg(F.count(F.lit(1)).alias("branches"), F.sum("hung_saved").alias("hung_saved"), F.sum("hung_leaves").alias("hung_leaves"))
    )
    nodes = nodes.join(tops.select("conv_id", "top", "end"), "conv_id").join(branches, ["conv_id", "depth"], "left").fillna(0, ["branches", "hung_saved", "hung_leaves"])
    goes_on = (F.col("depth") < F.col("end")).cast("bigint")
    nodes = nodes.withColumns(
        {
            "n_children": F.col("branches") + goes_on,
            "own_saved": F.col("saved") + F.col("hung_saved"),
            "own_leaves": F.col("hung_leaves") + ((F.col("branches") + goes_on) == 0).cast("bigint"),
        }
    )
    nodes = _along(nodes, "depth", {"saved_tokens": (F.sum, "own_saved"), "n_leaves": (F.sum, "own_leaves")}, downward=True)
    above = hung.select("conv_id", (F.col("depth") + 1).alias("depth"), "up")
    nodes = nodes.join(above, ["conv_id", "depth"], "left").join(_joined_ids(ends), ["depth", "a", "b"], "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up"))
    return nodes.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
