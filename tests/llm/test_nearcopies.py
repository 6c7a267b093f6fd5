"""Near copies at an exact limit: links against brute force over the distinct shingles of all pairs."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from driftgate.llm import nearcopies


def shingled(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute(texts, limit=0.8):
    """Pairs by similarity, and the smallest id of each id's group."""
    sets = {i: shingled(t) for i, t in texts.items()}
    root, pairs = {i: i for i in texts}, {}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared:
                pairs[a, b] = shared / (len(sets[a]) + len(sets[b]) - shared)
                if pairs[a, b] >= limit:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    """Originals of 40 to 400 words, each with copies in which 0 to 6 % of the words differ, and a large family."""
    rng = np.random.default_rng(5)
    texts = {}

    def copied(words, share):
        found = words.copy()
        for at in rng.choice(len(words), int(round(share * len(words))), replace=False):
            found[at] = f"x{rng.integers(1 << 30)}"
        return " ".join(found)

    for _ in range(120):
        words = np.array([f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 400))], object)
        texts[len(texts)] = " ".join(words)
        for _ in range(3):
            texts[len(texts)] = copied(words, rng.uniform(0, 0.06))
    words = np.array([f"w{x}" for x in rng.integers(0, 5000, 150)], object)
    for _ in range(150):
        texts[len(texts)] = copied(words, 0.02)
    return texts


def test_links_are_those_of_brute_force(spark, texts):
    pairs, want = brute(texts)
    border = [s for s in pairs.values() if 0.7 <= s < 0.9]
    assert sum(s >= 0.8 for s in border) > 50 and sum(s < 0.8 for s in border) > 50
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, n_chars int")
    stayed = {r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()}
    assert stayed == set(want.values())


def test_exact_limit_short_and_repeated_texts(spark):
    base = [f"w{i}" for i in range(22)]  # 18 shingles; one word more makes 19
    rows = [(1, " ".join(base)), (2, " ".join(base[:20])), (3, "A b"), (4, "a  B"), (5, None), (6, " "), (7, "a b c"), (7, "a b c"), (None, "a b"),
            (10, "p q r s t u v w x"), (11, "p q r s t u v w"), (12, "p q r s t u v"), (13, "m n o p q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # 10 and 11 share four of five shingles, just enough; 11 and 12 three of four
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect()) == [1, 3, 5, 7, 10, 12, 13]
