"""Ranked lexical search: exact inner products of sparse vectors, found through ball trees."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import kept

TREE_ROWS = 8192  # documents of one tree
LEAF_ROWS = 64
BLOCK_TERMS = 1 << 19  # terms of all items that are searched for together, about
_BATCH = 256  # texts that are taken apart at a time

#: By byte of UTF-8: letters and digits of ASCII, A-Z as a-z, and every byte beyond ASCII stay; others become a blank.
_TERM_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if chr(x).isalnum() or x > 127 else 32 for x in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... lengths[i] of them, for every i in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@dataclass
class Rows:
    """Sparse rows of whole numbers: row i has ``value`` at ``term`` between ``begin[i]`` and ``begin[i + 1]``, terms ascending."""

    begin: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        lengths = self.begin[rows + 1] - self.begin[rows]
        at = _spans(self.begin[rows], lengths)
        return Rows(np.concatenate([[0], np.cumsum(lengths)]), self.term[at], self.value[at])

    def sums(self, products: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(products)])
        return total[self.begin[1:]] - total[self.begin[:-1]]

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return self.sums(self.value * dense[self.term])

    def __len__(self) -> int:
        return len(self.begin) - 1


@dataclass
class Ball:
    """A centre of whole numbers, the radius of the ball and, by term, the radius along that axis; all rounded outward."""

    term: np.ndarray
    centre: np.ndarray
    reach: np.ndarray
    radius: float


class BallTree:
    """Balls of documents down to leaves, and for each term the balls that hold it.

    A ball's bound for a query with weights w is the lower of two that no inner product inside can exceed: w times the centre
    plus the length of w times the radius, and w times (centre plus radius by term). Terms that no document of the ball has
    add nothing to either. Bounds are computed in doubles from rounded-up parts and get a margin far above their error.
    """

    def __init__(self, rows: Rows, n_terms: int, leaf_rows: int = LEAF_ROWS):
        self.rows, self.children, self.members = rows, [], []
        balls: list[Ball] = []
        dense = np.zeros(n_terms, np.int64)
        stack = [(np.arange(len(rows)), -1)] if len(rows) else []
        while stack:
            at, parent = stack.pop()
            inside = rows.take(at)
            ball = self._ball(inside)
            number = len(balls)
            balls.append(ball)
            self.children.append([])
            self.members.append(None)
            if parent >= 0:
                self.children[parent].append(number)
            parts = self._halves(inside, ball, dense) if len(at) > leaf_rows else None
            if parts is None:
                self.members[number] = at
            else:
                stack += [(at[parts], number), (at[~parts], number)]
        # by term: the balls that hold it, their centres and reaches
        lengths = np.array([len(b.term) for b in balls], np.int64)
        term = np.concatenate([b.term for b in balls]) if balls else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.holder = np.repeat(np.arange(len(balls)), lengths)[order]
        self.centre = (np.concatenate([b.centre for b in balls]) if balls else term)[order].astype(np.float64)
        self.highest = (np.concatenate([b.centre + b.reach for b in balls]) if balls else term)[order].astype(np.float64)
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.radius = np.array([b.radius for b in balls])

    @staticmethod
    def _ball(rows: Rows) -> Ball:
        n = len(rows)
        order = np.argsort(rows.term, kind="stable")
        term, value = rows.term[order], rows.value[order]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        if not len(starts):
            return Ball(term, value, value, 0.0)
        total, count = np.add.reduceat(value, starts), np.diff(np.append(starts, len(term)))
        centre = total // n
        high, low = np.maximum.reduceat(value, starts), np.minimum.reduceat(value, starts)
        low = np.where(count < n, 0, low)  # a document without the term is at nought
        reach = np.maximum(high - centre, centre - low)
        # squared distance: |x|^2 - 2 x c + |c|^2, in doubles; the margin covers their rounding
        own = centre.astype(np.float64)
        where = np.repeat(np.arange(len(starts)), count)
        back = np.empty(len(term), np.int64)
        back[order] = where
        x = rows.value.astype(np.float64)
        far = rows.sums((x - own[back]) ** 2 - own[back] ** 2) + (own**2).sum()
        largest = float(np.abs(far).max()) + float((own**2).sum())
        return Ball(term[starts], centre, reach, math.sqrt(max(float(far.max()), 0.0) + 1e-9 * largest + 1.0) * (1 + 1e-12))

    @staticmethod
    def _halves(rows: Rows, ball: Ball, dense: np.ndarray) -> np.ndarray | None:
        """Which documents are nearer to one of two that lie far apart than to the other; half of them if that parts nothing."""

        def similar(row: int) -> np.ndarray:
            here = slice(rows.begin[row], rows.begin[row + 1])
            dense[rows.term[here]] = rows.value[here]
            found = rows.dot(dense).astype(np.float64)
            dense[rows.term[here]] = 0
            return found / lengths

        lengths = np.sqrt(rows.sums(rows.value.astype(np.float64) ** 2)) + 1.0
        near = similar(int(np.argmax(lengths)))
        one = int(np.argmin(near))
        near = similar(one)
        other = int(np.argmin(near))
        difference = near / lengths[one] - similar(other) / lengths[other]
        cut = np.median(difference)
        parts = difference > cut
        if not parts.any():
            parts = difference >= cut
        if parts.all() or not parts.any():
            parts = np.arange(len(rows)) % 2 == 0
        return parts

    def bounds(self, query: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """By ball, a number that no inner product with one of its documents exceeds."""
        lengths = self.first[query + 1] - self.first[query]
        at = _spans(self.first[query], lengths)
        w, n = np.repeat(weights.astype(np.float64), lengths), len(self.radius)
        holder = self.holder[at]
        by_axis = np.bincount(holder, w * self.highest[at], n)
        by_ball = np.bincount(holder, w * self.centre[at], n) + np.sqrt(np.bincount(holder, w * w, n)) * self.radius
        return np.minimum(by_axis, by_ball) * (1 + 1e-9) + 1.0


class Best:
    """The k best documents of one query so far: highest score first, equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> int:
        """No document below this score, or with it and a larger id than the last, can enter; 0 while there is room."""
        return self.heap[0][0] if len(self.heap) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        floor = self.least()
        for i in np.flatnonzero((scores >= floor) & (scores > 0)).tolist():
            entry = (int(scores[i]), -int(ids[i]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def search_tree(tree: BallTree, ids: np.ndarray, query: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: Best) -> int:
    """Puts what a query finds in a tree into ``best``, best ball first, and returns the number of documents it scored."""
    if not len(tree.radius):
        return 0
    bounds = tree.bounds(query, weights)
    dense[query] = weights
    queue, scored = [(-bounds[0], 0)], 0
    while queue:
        bound, ball = heapq.heappop(queue)
        if -bound < max(best.least(), 1):  # an equal score may still win by its id
            break
        if (members := tree.members[ball]) is None:
            for child in tree.children[ball]:
                heapq.heappush(queue, (-bounds[child], child))
        else:
            scored += len(members)
            best.add(tree.rows.take(members).dot(dense), ids[members])
    dense[query] = 0
    return scored


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents that score highest for each item, above 0.

    With N the documents that have a term, L all their terms and n a document's, df the documents that hold a term and tf its
    occurrences in one: a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 10 + 90 n N div L, and its
    score sums weight * (10^9 tf div (1000 tf + 8 m)) over the item's distinct terms, in whole numbers.

    Documents become sparse vectors over the items' terms. Every task grows ball trees of ``tree_rows`` documents one after
    another and searches each for all items, with the k-th best score so far as the limit; k rows an item and task are
    shuffled. Items are searched for in blocks of about ``block_terms`` terms (by a hash of the id), each broadcast, with one
    pass over the documents a block; the terms of one item are never parted.

    Every row of ``docs`` is a document of its own. One with a null id counts in the statistics and is never returned. Rows
    that repeat an item_id are one item with the terms of all; rows with a null item_id are left out. Null and empty texts
    have no terms. Equal scores rank by ascending id.
    """
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))

    def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = set(terms(text))
                of += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(found, pa.binary())], names=["item_id", "term"])

    pairs = kept(asked.mapInArrow(item_terms, "item_id bigint, term binary").distinct())
    blocks = max(1, -(-pairs.count() // block_terms))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    texts = docs.select(docs[doc_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    found = [_search_block(texts, pairs.where(F.col("block") == b), k, tree_rows) for b in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _search_block(texts: DataFrame, pairs: DataFrame, k: int, tree_rows: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    wanted = pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).toPandas()  # a block's size bounds it
    names = sorted({bytes(t) for found in wanted["terms"] for t in found})
    number = context.broadcast({t: i for i, t in enumerate(names)})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            for begin in range(0, batch.num_rows, _BATCH):
                part = batch.slice(begin, _BATCH)
                totals, held, times = [], [], []
                for text in part.column(1):
                    words = terms(text.as_py())
                    counts = Counter(words)
                    own = sorted((known[t], n) for t, n in counts.items() if t in known)
                    totals.append(len(words))
                    held.append([t for t, _ in own])
                    times.append([n for _, n in own])
                columns = [part.column(0), pa.array(totals, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "times"])

    rows = kept(texts.mapInArrow(vectors, "doc_id bigint, n bigint, terms array<int>, times array<bigint>"))
    n_docs, n_terms = rows.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row a term of the block
    weight = np.array([int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1)))) for i in range(len(names))], np.int64)
    queries = [(int(i), np.array(sorted(number.value[bytes(t)] for t in found), np.int64)) for i, found in zip(wanted["item_id"], wanted["terms"], strict=True)]
    shared = context.broadcast((queries, weight))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, weight = shared.value
        best = [Best(k) for _ in queries]
        dense = np.zeros(len(weight), np.int64)
        waiting: list[pd.DataFrame] = []

        def grow() -> None:
            rows = pd.concat(waiting)
            waiting.clear()
            ids, lengths = rows["doc_id"].to_numpy(np.int64), rows["terms"].map(len).to_numpy(np.int64)
            term = np.concatenate(rows["terms"].to_list()).astype(np.int64)
            times = np.concatenate(rows["times"].to_list()).astype(np.int64)
            m = np.repeat(10 + 90 * rows["n"].to_numpy(np.int64) * n_docs // n_terms, lengths)
            tree = BallTree(Rows(np.concatenate([[0], np.cumsum(lengths)]), term, 10**9 * times // (1000 * times + 8 * m)), len(weight))
            for (_, query), top in zip(queries, best, strict=True):
                search_tree(tree, ids, query, weight[query], dense, top)

        for batch in batches:
            for at in range(0, len(batch), tree_rows):
                waiting.append(batch.iloc[at : at + tree_rows])
                if sum(map(len, waiting)) >= tree_rows:
                    grow()
        if waiting and sum(map(len, waiting)):
            grow()
        rows = [(item, -doc, score) for (item, _), top in zip(queries, best, strict=True) for score, doc in top.heap]
        if rows:
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"])

    able = rows.where("doc_id is not null and size(terms) > 0")
    found = able.mapInPandas(nearest, "item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
