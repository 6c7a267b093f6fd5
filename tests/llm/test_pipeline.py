"""The pipeline's stages, each against plain Python on its own input."""

import re

import pytest

import corpus_pipeline as pipeline
import verify
from driftgate.llm import quality, simhash
from driftgate.llm.common import fold


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs)
    return kept


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_quality_rejects_by_score(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold("doc_id", 4) != 2)
    model = quality.fit(steps[0], labels)
    good, bad = model.compressors()
    want = {i for i, r in rows(steps[0]).items() if model.probability(quality.size_difference(r.text, good, bad)) >= 0.7}
    assert set(rows(steps[1])) == want


def test_lines(steps):
    before, after = rows(steps[1]), rows(steps[2])
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for i, r in before.items():
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    for i, r in before.items():
        kept = [x for x in (r.text or "").split("\n") if last.get(key(x), i) == i]
        assert after[i].text == "\n".join(kept) and after[i].n_chars == len(after[i].text)


def test_near_copies(steps):
    before, after = rows(steps[2]), rows(steps[3])
    words = {i: (r.text or "").lower().split() for i, r in before.items()}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    gone = set(before) - set(after)
    for i in gone:  # every row that went is like another one
        best = max(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) for j in before if j != i)
        assert best >= 0.7, i
    texts = [r.text for r in after.values()]
    assert len(texts) == len(set(texts)) and set(after) < set(before)


def test_near_copies_are_components_of_fingerprints(steps):
    """The stage keeps the smallest id of each component of op2's fingerprints, compared here pair by pair."""
    before, after = rows(steps[2]), rows(steps[3])
    fps = {i: simhash.fingerprint(r.text, 4) & (2**64 - 1) for i, r in before.items()}
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert set(after) == {i for i in fps if top(i) == i}


def test_decontamination(sf, steps):
    con = verify.connect(sf)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = set()
    for (text,) in con.execute("SELECT text FROM benchmark").fetchall():
        w = split(text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = {i for i, r in rows(steps[3]).items() if not any(tuple(w[p : p + 10]) in windows for w in [split(r.text)] for p in range(len(w) - 9))}
    assert set(rows(steps[4])) == clean


def test_tokens_of_every_row_that_is_left(steps):
    from tokenizers import Tokenizer

    from driftgate.llm.queries import tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    last = rows(steps[5])
    for i, r in rows(steps[4]).items():
        assert last[i].ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert len(last) == steps[4].count()


def test_run_is_the_stages_in_a_row(spark, sf, steps):
    assert {(r.doc_id, r.ids_sha256) for r in pipeline.run(spark, sf).collect()} == {(r.doc_id, r.ids_sha256) for r in steps[5].collect()}
