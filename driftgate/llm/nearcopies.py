"""Near copies by the Jaccard similarity of word shingles: candidates by MinHash bands, every link verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import fresh, kept
from driftgate.llm.components import components

SEED = 42
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
_BLOCK = 1024
_SLICE = 256  # rows whose shingles are held together
_SKETCH = [f"s{i}" for i in range((HASHES + 63) // 64)]
_DEVIATIONS = 5.2  # that a sketch may be off before its pair is no longer compared
_ROUNDS = 1  # in which groups of a key meet one member of its largest group, before all their members do

_draws = np.random.default_rng(SEED)
_MIX = _draws.integers(0, 1 << 32, HASHES, np.uint32)[:, None]
_FACTOR = _draws.integers(0, 1 << 32, HASHES, np.uint32)[:, None] | np.uint32(1)
_FOLD = _draws.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _draws.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words, or of none, is one shingle."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1]
    bounds = zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in bounds), np.uint64, len(starts)))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, and a bit of each minimum: of two texts, as many bits differ as half the dissimilarity says."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), _BLOCK):
        np.minimum(least, ((high[None, at : at + _BLOCK] ^ _MIX) * _FACTOR).min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=1, dtype=np.uint64) ^ _BAND
    bits = np.zeros(64 * len(_SKETCH), np.uint8)
    bits[:HASHES] = least >> np.uint32(8) & np.uint32(1)
    return keys.view(np.int64), np.packbits(bits, bitorder="little").view("<i8")


def _node(hashes: np.ndarray) -> int:
    """One number for a set of shingles."""
    value = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def _signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, th, node, n, sketch, keys) per row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("th"), text.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, bits = [], [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py(), words)
                nodes.append(_node(found))
                sizes.append(len(found))
                for kind, part in zip((keys, bits), signature(found), strict=True):
                    kind.append(part)
            sketches = [pa.array([int(b[i]) for b in bits], pa.int64()) for i in range(len(_SKETCH))]
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *sketches, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "th", "node", "n", *_SKETCH, "keys"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, th bigint, node bigint, n bigint, {', '.join(f'{s} bigint' for s in _SKETCH)}, keys array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (node, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = pa.array([shingles(x.as_py(), words).view(np.int64) for x in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles array<bigint>")


def _may_link(a: str, b: str, percent: int) -> Column:
    """What sizes and sketches leave open: none that is similar enough by its sizes, five in a hundred million by the sketches."""
    p = (100 - percent) / 200
    most = int(np.ceil(HASHES * p + _DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5))
    differing = [F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in _SKETCH]
    sizes = F.least(F.col(a + "n"), F.col(b + "n")) * 100 >= F.greatest(F.col(a + "n"), F.col(b + "n")) * percent
    return sizes & (sum(differing[1:], differing[0]) <= most)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose u and v share ``percent`` of a hundred of all their distinct shingles, or more."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "uv")
    both = pairs.join(left, "u").join(right, "v").withColumn("shared", F.size(F.array_intersect("u_set", "v_set")).cast("bigint"))
    union = F.size("u_set") + F.size("v_set") - F.col("shared")
    return both.where(F.col("shared") * 100 >= union * percent).select(*pairs.columns)


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with the label that ``merged``, (node, root) by label, gives theirs."""
    return rows.join(merged.select(F.col("node").alias("label"), "root"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of keys that hold more than one label."""
    keys = kept(rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key"))
    return rows.join(keys, "key")


def _with_shared(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rows`` with m, how many of a node's shingles another node of ``sets`` has too; without nodes that can have no link.

    A shingle that only one node has is in no pair's intersection, so m bounds what a pair of these nodes can share.
    """
    hashes = sets.select("node", F.explode("shingles").alias("h"))
    alone = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("nodes"), F.any_value("node").alias("node")).where("nodes = 1")
    alone = kept(alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone")))
    return rows.join(alone, "node", "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone").where(F.col("m") * 100 >= F.col("n") * percent)


def _can_share(a: str, b: str, percent: int) -> Column:
    """False where the smaller m, as an intersection, would still be too little for a link."""
    return F.least(F.col(a + "m"), F.col(b + "m")) * (100 + percent) >= (F.col(a + "n") + F.col(b + "n")) * percent


def _hub_pairs(rows: DataFrame, sign: list[str], turn: int, percent: int) -> DataFrame:
    """(u, v, a, b): by key, a member of each label and one of the label with most rows there; a and b are their labels.

    Which members, changes with ``turn``. There are as many pairs as labels by key, not as their members.
    """
    member = F.min_by(F.struct(*sign), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("rep")
    members = kept(rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"), member))
    size = F.struct("rows", F.xxhash64(F.lit(turn), "label"), "label")
    hubs = members.groupBy("key").agg(F.max_by(F.struct("label", "rep"), size).alias("hub"))
    pairs = members.join(hubs, "key").where((F.col("label") != F.col("hub.label")) & _can_share("rep.", "hub.rep.", percent) & _may_link("rep.", "hub.rep.", percent))
    return pairs.select(F.col("rep.node").alias("u"), F.col("hub.rep.node").alias("v"), F.col("label").alias("a"), F.col("hub.label").alias("b")).distinct()


def groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, first, root) per distinct set of shingles: root names its group, first is (none, id, th) of its smallest id.

    Texts are lower-cased (A-Z) and split at ASCII white space; a shingle is ``words`` words in a row, and repeats of it
    count once. Two texts link if ``percent`` of a hundred of all their shingles are in both; groups are what links
    reach. Texts with the same shingles (copies, and all texts without words, null ones included) are one node.

    A pair is compared if one of its 42 keys of six minima is equal: at a similarity of s this fails for (1 - s^6)^42 of
    the pairs, 3 in a million at 0.8. What is compared is decided by the shingles themselves, so no pair below the limit
    links. Every key's rows first meet its smallest and largest node only. Where a key still holds several groups, one
    member of each meets one of the largest there, other members each round, and groups that link become one. When a round
    joins nothing, or after a few, the rows of what groups are left are compared across groups. So no link is lost, and a
    large family's pairs are not written. Nor are those of its distant relatives: a node whose shingles are too often its
    own, among all nodes still compared, has no link, and is left out.
    """
    signed = _signed(docs, words, id_col, text_col)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "th")).alias("first")
    same = {c: F.any_value(c).alias(c) for c in ("n", *_SKETCH, "keys")}
    nodes = kept(signed.groupBy("node").agg(first, *same.values()))
    sign = ["node", "n", *_SKETCH]
    keyed = nodes.select(*sign, F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min(F.struct(*sign)).alias("lo"), F.max(F.struct(*sign)).alias("hi")).where("lo.node < hi.node")
    met = kept(keyed.join(ends, "key"))

    needed = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("first.id").alias("_first_id"), F.col("first.th").alias("_first_th"))
    text = F.coalesce(docs[text_col], F.lit(""))
    texts = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    needed = kept(needed)  # so that both sides of the join have a shuffle of their own
    texts = texts.join(needed, F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_th") == F.col("_first_th"))).select("node", "_text")
    sets = kept(_sets(texts.dropDuplicates(["node"]), words))

    stars = [met.where((F.col("node") != F.col(f"{e}.node")) & _may_link("", f"{e}.", percent)).select(F.col("node").alias("u"), F.col(f"{e}.node").alias("v")) for e in ("lo", "hi")]
    pairs = kept(stars[0].unionByName(stars[1]).distinct())
    near = kept(components(verified(pairs, sets, percent)))

    rows = met.select("key", *sign).join(near, "node", "left").select("key", *sign, F.coalesce("root", "node").alias("label"))
    rows = kept(_mixed(kept(rows)))
    sets = kept(sets.join(rows.select("node").distinct(), "node", "left_semi"))
    rows = kept(_mixed(kept(_with_shared(rows, sets, percent))))
    sign.append("m")
    edges = near.select(F.col("node").alias("u"), F.col("root").alias("v"))
    for turn in range(_ROUNDS):
        links = verified(kept(_hub_pairs(rows, sign, turn, percent)), sets, percent)
        merged = kept(components(links.select("a", "b").distinct(), "a", "b"))
        if merged.isEmpty():
            break
        edges = edges.unionByName(merged.select(F.col("node").alias("u"), F.col("root").alias("v")))
        rows = kept(_mixed(kept(_relabelled(rows, merged))))

    left, right = (rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)) for side in "ab")
    across = left.join(right, (F.col("a_key") == F.col("b_key")) & (F.col("a_label") < F.col("b_label")) & _can_share("a_", "b_", percent) & _may_link("a_", "b_", percent))
    pairs = kept(across.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"), F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
    edges = edges.unionByName(verified(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    roots = kept(components(edges))
    return nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, one row of each group of near copies: the one with the smallest id.

    Null ids come last. Of rows that repeat the chosen id and text, one stays. No rows give no rows.
    """
    first = groups(docs, words, percent, id_col, text_col).groupBy("root").agg(F.min("first").alias("first"))
    first = kept(first.select(F.col("first.id").alias("_first_id"), F.col("first.th").alias("_first_th")))
    (digest,) = fresh(docs, "th")
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    found = marked.join(first, marked[id_col].eqNullSafe(first["_first_id"]) & (marked[digest] == first["_first_th"]), "left_semi")
    return found.dropDuplicates([id_col, digest]).select(*docs.columns)
