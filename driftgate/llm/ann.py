"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import kept

BRANCHES = 8
LEAF_SAMPLE = 48  # sampled vectors in a leaf, at most
TILE = 4096  # vectors, or queries, that meet in one task's matrix product
_STEPS = 8  # of k-means at each node


@dataclass
class Tree:
    """Centres of all nodes, children of inner nodes, and numbers of leaves, in the space with one more dimension."""

    longest: float  # squared norm of the longest vector
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    children: list[list[int]] = field(default_factory=list)
    leaf_of: list[int] = field(default_factory=list)  # by node, -1 for inner nodes
    leaves: int = 0

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """With a last component that makes all lengths equal: then the nearest is the one of largest inner product."""
        rest = np.sqrt(np.maximum(self.longest - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node on to the nearest centre."""
        lifted = self.lifted(vectors)
        node = np.zeros(len(lifted), np.int64)
        found = np.full(len(lifted), -1, np.int64)
        open_nodes = [0]
        while open_nodes:
            at = open_nodes.pop()
            rows = np.flatnonzero(node == at)
            if self.leaf_of[at] >= 0:
                found[rows] = self.leaf_of[at]
                node[rows] = -1
            elif len(rows):
                below = np.array(self.children[at])
                node[rows] = below[_nearest(lifted[rows], self.centres[below])]
                open_nodes += below.tolist()
        return found

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best bin first: down to the nearest child, the others into a queue by their distance."""
        lifted = np.append(query, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, at = heapq.heappop(queue)
            while self.leaf_of[at] < 0:
                below = self.children[at]
                far = ((self.centres[below] - lifted) ** 2).sum(axis=1)
                best = int(far.argmin())
                for i, child in enumerate(below):
                    if i != best:
                        heapq.heappush(queue, (float(far[i]), child))
                at = below[best]
            yield self.leaf_of[at]


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def grow(sample: np.ndarray, longest: float, seed: int = 11) -> Tree:
    """A tree over sampled vectors; equal vectors stay in one leaf, however many."""
    tree = Tree(longest)
    lifted = tree.lifted(sample)
    random = np.random.default_rng(seed)
    centres = [lifted.mean(axis=0) if len(lifted) else np.zeros(lifted.shape[1])]
    tree.children, tree.leaf_of = [[]], [-1]
    open_nodes = [(0, lifted)]
    while open_nodes:
        at, rows = open_nodes.pop()
        distinct = np.unique(rows, axis=0) if len(rows) > LEAF_SAMPLE else rows
        if len(rows) <= LEAF_SAMPLE or len(distinct) <= BRANCHES:
            tree.leaf_of[at] = tree.leaves
            tree.leaves += 1
            continue
        means = distinct[random.choice(len(distinct), BRANCHES, replace=False)]
        for _ in range(_STEPS):
            near = _nearest(rows, means)
            means = np.stack([rows[near == i].mean(axis=0) if (near == i).any() else means[i] for i in range(BRANCHES)])
        near = _nearest(rows, means)
        parts = [i for i in range(BRANCHES) if (near == i).any()]
        if len(parts) == 1:
            tree.leaf_of[at] = tree.leaves
            tree.leaves += 1
            continue
        for i in parts:
            tree.children[at].append(len(centres))
            open_nodes.append((len(centres), rows[near == i]))
            centres.append(means[i])
            tree.children.append([])
            tree.leaf_of.append(-1)
    tree.centres = np.stack(centres)
    return tree


def _matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products, the same for the same pair wherever it stands."""
    return (queries * vectors).sum(axis=1)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best ids of ``vectors`` for each query, each with its best score, ties to smaller ids, the query's own id left out."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    scores = queries @ vectors.T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    if len(starts) > k:
        best = scores if len(starts) == len(ids) else np.maximum.reduceat(scores, starts, axis=1)
        kth = np.partition(best, len(starts) - k, axis=1)[:, -k]
        slack = 1e-9 * (1 + np.abs(kth))  # a product summed in another order may differ in the last bits
        q, v = np.nonzero((scores >= (kth - slack)[:, None]) & (scores > -np.inf))
    else:
        q, v = np.nonzero(scores > -np.inf)
    exact = _products(queries[q], vectors[v])
    if len(starts) < len(ids):
        order = np.lexsort((-exact, v_ids := ids[v], q))
        once = np.concatenate([[True], (np.diff(q[order]) != 0) | (np.diff(v_ids[order]) != 0)])[: len(q)]
        q, v, exact = (x[order[once]] for x in (q, v, exact))
    order = np.lexsort((ids[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    first = np.searchsorted(q, q)
    top = np.arange(len(q)) - first < k
    return pd.DataFrame({"query_id": query_ids[q[top]], "vec_id": ids[v[top]], "score": exact[top]})


_FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector as packed doubles) of the vectors that take part.

    Null, empty and zero vectors take none, nor do vectors with null or non-finite components, rows with a null id, and
    vectors of another dimension than the commonest (the smallest of equally common ones).
    """
    inf = float("inf")
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vector.alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: F.coalesce((x > -inf) & (x < inf), F.lit(False))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (sizes[0] if sizes else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().astype("<f8")
            rows = values.reshape(batch.num_rows, -1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id bigint, v binary")


def brute_force(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of a bounded set of queries against all rows, in blocks."""
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, wanted = shared.value
        for batch in batches:
            for at in range(0, len(batch), TILE):
                part = batch.iloc[at : at + TILE]
                yield _best(ids, wanted, part["vec_id"].to_numpy(), _matrix(part["v"]), k)

    return _ranked(rows.select("vec_id", "v").mapInPandas(run, _FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k by query. An id that repeated rows found more than once counts once, with its best score."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _draw(rows: DataFrame, n: int, total: int, salt: int) -> pd.DataFrame:
    """About n of ``total`` rows, by a hash of the id, and no more than that; for the driver."""
    draw = F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1 << 30))
    share = min(1.0, 1.1 * n / max(total, 1))
    return rows.withColumn("_draw", draw).where(F.col("_draw") < int(share * (1 << 30))).orderBy("_draw", "vec_id").limit(n).toPandas()


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.97, sample: int = 16_384, calibration: int = 256, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row that ``is_query`` (a column of the id) names.

    The tree is grown from at most ``sample`` vectors; every vector is then put into its leaf. At most ``calibration``
    queries are compared with all rows, and the number of leaves to visit is widened until these queries find the share
    ``recall`` of their true neighbours; every query visits that many leaves, and more where those hold k ids or fewer.
    Leaves with many vectors or many queries are split into tiles, each pair of tiles a bounded matrix product, so a leaf
    of equal vectors is no single task.

    Which vectors take part says ``usable``. Rows that repeat an id are one candidate with the better score, and one
    query. Without queries or candidates there are no rows.
    """
    rows = kept(usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "v"]))
    spark = rows.sparkSession

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"n": [len(batch)], "longest": [float((_matrix(batch["v"]) ** 2).sum(axis=1).max())]})

    total, longest = rows.mapInPandas(lengths, "n bigint, longest double").agg(F.sum("n"), F.max("longest")).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = grow(_matrix(_draw(rows, sample, total, 1)["v"]), longest)
    shared = spark.sparkContext.broadcast(tree)

    def into_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.assign(_matrix(batch["v"])))

    index = kept(rows.mapInPandas(into_leaves, "vec_id bigint, v binary, leaf bigint"))
    # by leaf, so as many numbers as the tree has leaves: its rows, and its ids, an id of several leaves in one of them only
    held, own = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():
        held[leaf] = n
    for leaf, n in index.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect():
        own[leaf] = n
    queries = index.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])

    # calibration: how far down its own list of leaves each true neighbour is
    tried = _draw(queries.select("vec_id", "v"), calibration, queries.count(), 2)
    if not len(tried):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    truth = brute_force(index, tried["vec_id"].to_numpy(), _matrix(tried["v"]), k).join(
        index.groupBy("vec_id").agg(F.min("leaf").alias("leaf")), "vec_id"
    ).select("query_id", "leaf").toPandas()
    places = {q: {leaf: i for i, leaf in enumerate(tree.visit(v))} for q, v in zip(tried["vec_id"], _matrix(tried["v"]), strict=True)}
    depth = np.array([places[q][leaf] for q, leaf in truth.itertuples(index=False)])
    visits = 1
    while visits < tree.leaves and len(depth) and (depth < visits).mean() < recall:
        visits = min(tree.leaves, max(visits + 1, visits * 5 // 4))

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                which, leaves = [], []
                for i, query in enumerate(_matrix(part["v"])):
                    seen = 0
                    for n, leaf in enumerate(shared.value.visit(query)):
                        if n >= visits and seen > k:
                            break
                        if held[leaf]:
                            which.append(i)
                            leaves.append(leaf)
                            seen += own[leaf]
                yield pd.DataFrame({"query_id": part["vec_id"].to_numpy()[which], "q": part["v"].to_numpy()[which], "leaf": leaves})

    asked = kept(queries.select("vec_id", "v").mapInPandas(visited, "query_id bigint, q binary, leaf bigint"))
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    asked_sizes = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("query_tiles"))
    cells = F.broadcast(kept(sizes.join(asked_sizes, "leaf")))  # one narrow row a leaf
    left = index.join(cells, "leaf").withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.col("tiles")).cast("int"))
    left = left.select("leaf", "tile", F.explode(F.sequence(F.lit(0), F.col("query_tiles") - 1)).alias("query_tile"), "vec_id", "v")
    right = asked.join(cells, "leaf").withColumn("query_tile", F.pmod(F.xxhash64("query_id"), F.col("query_tiles")).cast("int"))
    right = right.select("leaf", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "query_tile", "query_id", "q")

    def meet(vectors: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asking):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, values = vectors["vec_id"].to_numpy(), _matrix(vectors["v"])
        parts = [asking.iloc[at : at + 512] for at in range(0, len(asking), 512)]
        return pd.concat([_best(p["query_id"].to_numpy(), _matrix(p["q"]), ids, values, k) for p in parts])

    key = ["leaf", "tile", "query_tile"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, _FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
