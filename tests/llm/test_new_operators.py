"""Packing, prefix trie and lexical search: against brute force and the libraries, and the odd cases of each."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.llm import lexical, packing, prefixes
from driftgate.llm.queries import QUERIES, tokenizer

BYTES = tokenizer("byte_bpe_50k.json")
EXTRA = "doc_id bigint, text string, _item int, _size string, length int, piece int, sequence_id int, n int, terms string"


def docs(spark, rows, schema=EXTRA):
    return spark.createDataFrame([(*r, *[None] * (len(schema.split(",")) - 2)) for r in rows], schema)


# packing


def test_ids_are_the_librarys(monkeypatch):
    library = packing.load(BYTES).library
    rnd = random.Random(5)
    odd = ["", " ", "  a", "a  b \n c\n\n d", "<|endoftext|> x<|endoftext|>", " 's don't  'LL", "\n \nbar \t x", "é à ²x ½ ①", "日本 語 a", "x" * 300 + " " + "y" * 300]
    odd += ["".join(rnd.choice(" \n\tab'sé!1 \u0085　語 <|endoftext|>") for _ in range(rnd.randrange(60))) for _ in range(2000)]
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(packing, "_STRETCH", stretch)
        for text in odd:
            assert list(packing.load(BYTES).encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def fewest(sizes, capacity):
    """The fewest bins, by trying all."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:j]:
                place(i + 1, [*rooms[:j], room - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    rnd = random.Random(3)
    met = 0
    for _ in range(300):
        capacity = rnd.choice([10, 17, 30])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
        low = packing.bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        best = fewest(sizes, capacity)
        assert Fraction(sum(sizes), capacity) <= low <= best
        met += math.ceil(low) == best
        bins, places, room = packing.best_fit(np.array(sizes), capacity)
        assert best <= len(room) and all(0 <= p and p + s <= capacity for p, s in zip(places, sizes, strict=True))
    assert met > 250


def check_packing(rows, capacity):
    """Every sequence is gapless from 0 and holds at most ``capacity``; the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_packing"](spark, folder).collect()
    library, expected = packing.load(BYTES).library, set()
    for doc, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or min(len(ids), 2048), len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            expected.add((doc, i, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())))
    assert len(rows) == len(expected) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert check_packing(rows, 2048) == math.ceil(sum(r.length for r in rows) / 2048)


def test_exchange_between_parts(spark):
    """Small parts leave unfilled bins; the exchange comes close to the bound of all."""
    rnd = random.Random(9)
    sizes = [rnd.choice([3, 7, 11, 19, 31, 43, 57, 64, 90, 100]) for _ in range(3000)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id int, length int")
    low = math.ceil(packing.bound(np.bincount(sizes, minlength=101), 100))
    alone = check_packing(packing.pack(items, F.col("length"), 100, part_rows=100, rounds=0).collect(), 100)
    rows = packing.pack(items, F.col("length"), 100, part_rows=100).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    after = check_packing(rows, 100)
    assert low <= after < alone and after <= 1.01 * low
    # every size above half: certified at once, one bin each
    large = packing.pack(items.selectExpr("id", "51 + length % 50 AS length"), F.col("length"), 100, part_rows=100).collect()
    assert check_packing(large, 100) == 3000


def test_packing_cases(spark):
    long = "word " * 50_000
    odd = docs(spark, [(1, None), (2, ""), (3, long), (4, "same"), (4, "same"), (None, "no id")])
    cut = packing.pieces(odd, BYTES, capacity=2048, with_ids=True)
    rows = packing.pack(cut, F.col("length")).collect()
    check_packing(rows, 2048)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [(r.length, r.ids) for r in by[1]] == [(1, b"\0" * 4)] == [(r.length, r.ids) for r in by[2]]
    assert len(by[4]) == 2 and len(by[None]) == 1
    whole = sorted(by[3], key=lambda r: r.piece)
    assert all(r.length == 2048 for r in whole[1:]) and b"".join(r.ids for r in whole)[:-4] == packing.load(BYTES).encode(long).tobytes()
    assert packing.pack(packing.pieces(docs(spark, []), BYTES), F.col("length")).count() == 0
    # columns with the operator's own names come back as they were
    named = spark.createDataFrame([(5, 1, 2, 3)], "length int, item int, _item int, bin int")
    assert packing.pack(named, F.col("length"), 10).select("length", "item", "_item", "bin").collect() == [(5, 1, 2, 3)]
    with pytest.raises(Exception, match="outside 1 to capacity"):
        packing.pack(named, F.col("length"), 4).collect()


# prefix trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    told = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            told[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda y: y[:2])] for c, v in told.items()}
    nodes, size = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - c % 5, [])[:h] + own[c][h:]
        size[c] = len(turns)
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        members = sorted(nodes[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(str(c) for c in members if size[c] == len(k))
        out.append((members[0], len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie(spark, rows, schema="conv_id bigint, turn bigint, role string, text string"):
    found = prefixes.trie(*prefixes.rebuilt(spark.createDataFrame(rows, schema)))
    return sorted(map(tuple, found.select(NODE).collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_few_turns(spark, seed, monkeypatch):
    """Many shared beginnings, some longer than a block or a window, gaps in ids and in turns."""
    rnd = random.Random(seed)
    monkeypatch.setattr(prefixes, "_LONG", 16)
    monkeypatch.setattr(prefixes, "_CHUNK", 4)
    rows = []
    for c in rnd.sample(range(90), 60):
        straight, n = rnd.random() < 0.4, rnd.choice([1, 2, 3, 7, 8, 9, 17, 40])
        for t in range(n):
            rows.append((c, t * 2 if t else None, rnd.choice(["user", None]) if not straight else "user", "é" * (1 if straight else rnd.randint(0, 2)) or None))
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_a_staircase(spark):
    """Each conversation leaves the one before it a turn later, so paths hang from each other in a long chain."""
    rows = [(10 + 5 * i, t, "user", "on" if t < i else f"off {i}") for i in range(40) for t in range(i + 3)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_cases(spark):
    assert trie(spark, []) == []
    odd = [(None, 0, "user", "nobody's"), (7, None, None, None), (7, 1, "user", "x" * 200_000), (7, 1, "user", "x" * 200_000), (8, 5, None, ""), (8, 5, "", None)]
    assert trie(spark, odd) == brute_trie(odd)
    extra = [(*r, 1, 2, 3) for r in odd]
    assert trie(spark, extra, "conv_id bigint, turn bigint, role string, text string, place int, a int, depth int") == brute_trie(odd)


# lexical search


def brute_search(texts, items, k=10):
    def terms(text):
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    words = [(d, Counter(terms(t))) for d, t in texts]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, w in words:
            m = 10 + 90 * sum(w.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in own if w[t])
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def searched(spark, texts, items, **more):
    found = lexical.search(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), **more)
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("block_terms,tree_rows", [(1 << 19, 8192), (60, 40)])
def test_search_finds_what_all_pairs_give(spark, block_terms, tree_rows):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(80)] + ["Ünder", "日本", "A-B", "x.y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [(i % 700, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(900)]
    texts += [(5000, "only here"), (None, "only here too"), (5001, None), (5002, "")] + [(6000 + i, "copy w1 w2") for i in range(300)]
    items = [(i, " ".join(rnd.choices(words, k=12))) for i in range(20)] + [(50, "only copy"), (51, None), (52, ""), (53, "nowhere"), (None, "w1"), (3, "again copy")]
    assert searched(spark, texts, items, block_terms=block_terms, tree_rows=tree_rows) == brute_search(texts, items)


def test_search_cases(spark):
    assert searched(spark, [], [(1, "a")]) == [] == searched(spark, [(1, "a")], []) == searched(spark, [(1, None)], [(1, "a")])
    long = "very " * 200_000 + "rare"
    assert searched(spark, [(1, long), (2, "rare")], [(1, "RARE very")]) == brute_search([(1, long), (2, "rare")], [(1, "RARE very")])


def test_bounds_of_balls_hold():
    """No inner product inside a ball exceeds the ball's bound, and the search prunes."""
    rng = np.random.default_rng(2)
    n, width = 600, 200
    hits = rng.random((n, width)) < np.where(np.arange(n)[:, None] % 3 == np.arange(width) % 3, 0.3, 0.01)
    value = rng.integers(1, 10**6, (n, width)) * hits
    begin = np.concatenate([[0], np.cumsum(hits.sum(axis=1))])
    tree = lexical.BallTree(lexical.Rows(begin, np.nonzero(hits)[1], value[hits]), width, leaf_rows=8)
    inside = [None] * len(tree.radius)
    for ball in reversed(range(len(tree.radius))):
        inside[ball] = tree.members[ball] if tree.members[ball] is not None else np.concatenate([inside[c] for c in tree.children[ball]])
    assert sorted(inside[0].tolist()) == list(range(n))
    seen = 0
    for kind in range(30):
        query = np.sort(rng.choice(np.arange(kind % 3, width, 3), 15, replace=False))
        weights = rng.integers(1, 9000, 15)
        scores = value[:, query] @ weights
        bounds = tree.bounds(query, weights)
        assert all(bounds[b] >= scores[inside[b]].max() for b in range(len(bounds)))
        best = lexical.Best(5)
        seen += lexical.search_tree(tree, np.arange(n), query, weights, np.zeros(width, np.int64), best)
        assert sorted(best.heap, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:5]
    assert seen < 0.9 * 30 * n
