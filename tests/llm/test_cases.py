"""Small cases: nulls, empty and very long texts, ties, repeated rows, empty tables, columns whose names clash."""

import random
import re

import numpy as np
import pytest

from driftgate.llm import ann, bpe, langid, licenses, linededup, pii, quality, simhash, token_scan, winnow
from driftgate.llm.components import components
from driftgate.llm.queries import tokenizer

WORDS = tokenizer("word_bpe_49k.json")
EXTRA = "doc_id bigint, text string, _id int, _th int, _text string, key int, score double, lines int, fp bigint, node int, n_tokens int"


def docs(spark, rows, schema=EXTRA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - 2)) for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """A null text, an empty one, a very long one, a repeated row, a null id."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return docs(spark, [(1, None), (2, ""), (3, long), (4, "Plain text here."), (4, "Plain text here."), (None, "No id at all."), (5, "\n \n")])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# 1


def test_quality_cases(spark, odd, none):
    good = [(i, f"calm steady words about gardens and rivers number {i} " * 5) for i in range(40)]
    bad = [(100 + i, f"BUY!!! $$$ NOW {i} ### " * 9) for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.fit(docs(spark, good + bad), labels)
    found = {r.doc_id: r for r in quality.scores(docs(spark, good[:5] + bad[:5]), model).collect()}
    assert all(found[i].predicted == (i < 100) for i in found)
    assert quality.scores(odd, model).count() == 7 and quality.scores(none, model).count() == 0
    empties = {r.doc_id: r.score for r in quality.scores(odd, model).where("doc_id in (1, 2)").collect()}
    assert empties[1] == empties[2] and 0 <= empties[1] <= 1
    kept = quality.accepted(odd, model, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == 7
    # the size difference is of the whole text
    pair = model.compressors()
    assert quality.size_difference(good[0][1] * 300 + bad[0][1] * 900, *pair) < quality.size_difference(good[0][1] * 300, *pair)


def test_quality_without_two_labels(spark, none, odd):
    assert quality.fit(none, spark.createDataFrame([], "doc_id bigint, quality int")) == 0.5
    one = quality.fit(odd, spark.createDataFrame([(3, 1), (4, 1), (4, 0)], "doc_id bigint, quality int"), most_chars=10**7)
    assert one == 1.0
    assert {r.score for r in quality.scores(odd, one).collect()} == {1.0}


# 2


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for i, bits in enumerate(rng.integers(0, 5, len(b))):
        for bit in rng.choice(64, bits, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    sets = []
    for x in (a, b):
        rows, keys = simhash.golay_keys(x)
        found = [set() for _ in x]
        for r, k in zip(rows, keys, strict=True):
            found[r].add(k)
        sets.append(found)
    assert all(x & y for x, y in zip(*sets, strict=True))
    # every two 23-bit words at distance two or less share an index
    words = rng.integers(0, 2**23, 2000)
    for p in range(23):
        for q in range(p, 23):
            other = words ^ (1 << p) ^ ((1 << q) if q != p else 0)
            x, y = simhash.golay_indices(words), simhash.golay_indices(other)
            assert ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any(axis=(1, 2)).all()


def test_simhash_cases(spark, odd, none):
    rows = {(r.doc_id, r.fp): r for r in simhash.near_duplicates(odd).collect()}
    assert {i for i, fp in rows if fp == 0} == {1, 2, 5}
    assert all(r.component_id == 1 for (_, fp), r in rows.items() if fp == 0)
    assert simhash.near_duplicates(odd).where("doc_id = 4").count() == 2
    assert simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd, most_differing=5)


def test_simhash_family_and_chain(spark):
    """A family around one fingerprint, a chain in steps of four bits, and strangers."""
    rng = np.random.default_rng(9)
    centre, chain = 0x1234_5678_9ABC_DEF0, [0]
    family = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2)) if a != b}
    for i in range(12):
        chain.append(chain[-1] ^ (0xF << (4 * i)))
    strangers = rng.integers(0, 2**64, 300, dtype=np.uint64).tolist()
    values = [v - 2**64 if v >= 2**63 else v for v in sorted({*family, *chain, *strangers})]
    found = {r.node: r.root for r in simhash.linked(spark.createDataFrame([(v,) for v in values], "fp bigint")).collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for n, a in enumerate(values):
        for b in values[n + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups, want = {}, {}
    for v in values:
        groups.setdefault(found.get(v, v), set()).add(v)
        want.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (9, 9), (7, 8), (None, 4)] + [(i, i + 1) for i in range(100, 160)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# 3


def test_neighbour_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]),
            (8, [1.0]), (9, [-2.0, 0.1]), (9, [3.0, 0.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, leaf int, v int")
    found = ann.search(df, lambda x: x % 20 == 0, k=3).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20)}
    assert got == {0: [(9, 3.0), (1, 1.0), (2, 1.0)], 20: [(9, 3.0), (0, 1.0), (1, 1.0)]}
    few = ann.search(df.where("vec_id < 3"), lambda x: x == 0, k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.search(df.where("false"), lambda x: x == 0).count() == 0
    assert ann.search(df, lambda x: x == 77).count() == 0


def test_neighbours_of_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    same = [(i, [0.6, 0.8, 0.0]) for i in range(3000)]
    other = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in zip(range(3000, 4000), rng.normal(size=(1000, 3)), strict=True)]
    df = spark.createDataFrame(same + other, "vec_id bigint, embedding array<double>")
    found = ann.search(df, lambda x: x.isin(0, 100, 3000), k=20, sample=500).collect()
    for q in (0, 100):
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [i for i in range(21) if i != q][:20]


def test_neighbours_of_repeated_ids(spark):
    """Ids with more rows than k, copies and other vectors, near the queries: every query still gets k different ids."""
    rng = np.random.default_rng(8)
    own = rng.normal(size=(60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(own)]
    rows += [(7, own[7].tolist())] * 50 + [(11, (own[11] + x).tolist()) for x in rng.normal(size=(50, 4)) / 50]
    rows += [(i, v.tolist()) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    best = {}
    for i, v in rows:
        for q in (0, 5):
            best[q, i] = max(best.get((q, i), -np.inf), float(own[q] @ np.array(v)))
    for sample in (500, 20):
        found = ann.search(df, lambda x: x.isin(0, 5), k=20, recall=1.0, sample=sample).collect()
        for q in (0, 5):
            got = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
            assert len(set(got)) == len(got) == 20
            if sample == 500:
                assert got == sorted((i for i in range(60) if i != q), key=lambda i: (-best[q, i], i))[:20]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    near = ann._best(np.array([0, 7]), own[[0, 7]] , ids, vectors, 20)
    assert near.groupby("query_id")["vec_id"].nunique().tolist() == [20, 20] and len(near) == 40


# 4


def test_token_scan_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    want, paths = [], []
    for n, size in enumerate([5000, 3000, 0, 17]):
        ids = rng.integers(0, 50 if n else 3, size=size).astype("<u2")
        paths.append(f"{tmp_path}/{n}.bin")
        ids.tofile(paths[-1])
        start = ordinal = 0
        for i in np.flatnonzero(ids == 0).tolist():
            want.append((paths[-1], ordinal, start, i - start, True))
            start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            want.append((paths[-1], ordinal, start, len(ids) - start, False))
    files = spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "file string")
    for block in (3, 64, 1 << 20):
        assert sorted(map(tuple, token_scan.scan(files, 0, block_tokens=block).collect())) == sorted(want)
    (tmp_path / "half.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within a token"):
        token_scan.token_counts_of_files(spark, [f"{tmp_path}/half.bin"], 0).collect()


def test_token_count_cases(spark, odd, none):
    path = tokenizer("byte_bpe_50k.tiktoken")
    found = token_scan.token_counts(odd, path, 50256).collect()
    assert sorted((r.n_tokens for r in found if r.doc_id in (1, 2))) == [0, 0]
    assert len(found) == 7 and sum(r.doc_id == 4 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1
    assert token_scan.token_counts(none, path, 50256).count() == 0


# 5


def test_every_known_sentence_has_a_clue():
    assert all(re.search(licenses.CLUES, s) for s in licenses.known_sentences())
    assert {name for _, names in licenses.RULES for name in names} <= set(licenses.SENTENCES)


def test_licence_cases(spark, odd, none):
    grant = licenses.SENTENCES
    mit = "\n\n".join(grant[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    wrong_order = "\n\n".join(grant[k][0] for k in ("bsd-binary", "bsd-grant", "bsd-source"))
    wrapped = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n#\n# ok"
    two = "Released under the MIT License. Some prose.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."
    cases = [(1, mit), (2, wrong_order), (3, wrapped), (4, two), (5, "the licence of a poet"), (6, "/* SPDX-License-Identifier: ISC */\nint x;")]
    found = {r.doc_id: r for r in licenses.scan(docs(spark, cases)).collect()}
    assert [found[i].licences for i in range(1, 7)] == [["MIT"], [], ["Apache-2.0"], ["CC-BY-NC-4.0", "MIT"], [], ["ISC"]]
    assert found[4].sentence_ids == ["mit-ref", "cc-by-nc-ref", "mit-ref"]
    assert all(r.licences == [] for r in licenses.scan(odd).collect()) and licenses.scan(odd).count() == 7
    assert licenses.scan(none).count() == 0


# 6


def test_language_cases(spark, odd, none):
    schema = "doc_id bigint, text string, lang string, score double"
    rows = [(i, f"der hund und die katze schlafen {i} ungeheuer", "de", None) for i in range(60)]
    rows += [(100 + i, f"the dog and the cat are sleeping {i} through", "en", None) for i in range(60)] + [(300, None, "de", None), (301, "xx", None, None)]
    model = langid.fit(spark.createDataFrame(rows, schema))
    ask = [(1, "the cat and the dog"), (2, "die katze und der hund"), (3, None), (4, ""), (5, "123 -- 456"), (5, "123 -- 456"), (None, "the " * 400_000)]
    found = sorted(((r.doc_id or 9, r.lang_pred, r.score) for r in langid.predict(docs(spark, ask), model).collect()))
    assert [f[1] for f in found] == ["en", "de", "und", "und", "und", "und", "en"]
    assert all((s == 0) == (x == "und") for _, x, s in found)
    assert langid.predict(none, model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], schema))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("chunk", [3, 50, 700])
def test_language_features_of_long_texts_are_those_of_whole_texts(monkeypatch, chunk):
    text = "".join(random.Random(1).choice("abc dé1 .") for _ in range(5000))
    whole = dict(zip(*(x.tolist() for x in langid.features(text)), strict=True))
    monkeypatch.setattr(langid, "_CHUNK", chunk)
    assert dict(zip(*(x.tolist() for x in langid.features(text)), strict=True)) == whole


def test_language_of_signs_that_are_no_letters(spark):
    rows = [(i, text, lang) for i in range(30) for text, lang in ((f"der hund schläft {i}", "de"), (f"the dog sleeps {i}", "en"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert [model.predict(x)[0] for x in ("²½ ①", "_1_", "٣ 4", "\u0301")] == ["und"] * 4
    assert model.predict("² hund der")[0] == "de"


# 7


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_contamination(rows, items, window=10):
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            v = split(t)
            n = min(len(v), window)
            if item is None or not n:
                continue
            grams = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        yield i, len(w), sorted(hit), sorted(found)


def test_winnowing_misses_nothing(spark, none):
    rng = random.Random(4)
    letters = "abcd"
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 6, 7, 9, 10, 11, 14, 25]))) for i in range(30)] + [(None, "a b c d"), (31, None), (32, ""), (33, "...")]
    rows = [(i, text(rng.choice([0, 1, 5, 30, 80]))) for i in range(40)] + [(90, None), (91, items[0][1] * 3)]
    rows += [(92, " ".join(f"x{i}" for i in range(3000)) + " " + items[8][1]), (1, "É été A-B a_b"), (1, "É été A-B a_b"), (None, items[3][1])]
    bench = spark.createDataFrame([(a, b, None) for a, b in items], "item_id bigint, text string, hash int")
    found = winnow.contamination(docs(spark, rows), bench).collect()
    want = list(brute_contamination(rows, items))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r.doc_id, r.n_words, list(r.places), list(r["items"])) for r in found), key=key) == sorted(want, key=key)
    assert all(r.n_hit == len(r.places) and r.contaminated == (r.n_hit > 0) for r in found)
    clean = winnow.without_contaminated(docs(spark, rows), bench)
    assert clean.count() == sum(not w[2] for w in want) and clean.columns == docs(spark, []).columns
    assert winnow.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in winnow.contamination(docs(spark, rows), bench.where("false")).collect())


def test_winnowing_with_a_shuffled_benchmark(spark, monkeypatch):
    monkeypatch.setattr(winnow, "_SMALL_ROWS", 0)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    found = winnow.contamination(docs(spark, [(1, "x two three four five six seven eight nine ten eleven y"), (2, "two three four")]), bench)
    assert {(r.doc_id, r.n_hit) for r in found.collect()} == {(1, 10), (2, 0)}


# 8


def test_line_cases(spark, odd, none):
    shared, short = "This very line is in more than five documents.", "short line"
    rows = [(i, f"own {i}\n  {shared.upper() if i % 2 else shared}\t\n{short}\n") for i in range(1, 7)]
    rows += [(9, f"{shared}\n{shared}\nend"), (9, f"{shared}\n{shared}\nend"), (None, f"{shared}\nx"), (10, None), (11, ""), (12, "\n")]
    found = linededup.drop_common_lines(docs(spark, rows), lines_col="n_lines", dropped_col="n_dropped").collect()
    got = sorted((r.doc_id or 0, r.text or "", r["n_lines"], r.n_dropped) for r in found)
    want = [(i, f"own {i}\n{short}\n", 4, 1) for i in range(1, 7)] + [(9, f"{shared}\n{shared}\nend", 3, 0)] * 2
    want += [(0, "x", 2, 1), (10, "", 1, 0), (11, "", 1, 0), (12, "\n", 2, 0)]
    assert got == sorted(want)
    assert [r.text for r in found if r.doc_id == 10] == [None]
    assert linededup.drop_common_lines(odd).columns == odd.columns and linededup.drop_common_lines(odd).count() == 7
    assert linededup.drop_common_lines(none).count() == 0


def test_lines_of_a_repeated_id_are_one_document(spark):
    line = "This very line is in only four different documents."
    rows = [(1, line), (1, line), (1, f"{line}\nother"), (2, line), (3, line), (4, line)]
    assert {r.text.split("\n")[0] for r in linededup.drop_common_lines(docs(spark, rows)).collect()} == {line}
    assert linededup.common_lines(docs(spark, rows), min_docs=4).count() == 1


# 9


def test_bpe_cases(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    odd_texts = ["", "  ", "Σας ΟΔΟΣ", "İstanbul", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "a\x1cb\x1f c\u0085d", "it's WE'LL I'M", "x" * 5000,
                 "ab" * 3000 + "é", "½ Ⅷ ² don't123", "😀👍🏽 مرحبا 你好", "\x00\x01", "é<|endoftext|>́"]
    encoder = bpe.load(WORDS)
    for text in odd_texts:
        ids = encoder.encode(text)
        assert list(ids) == library.encode(text, add_special_tokens=False).ids, text
        assert encoder.decode(ids) == library.decode(list(ids), skip_special_tokens=False)
    found = bpe.encode(odd, WORDS).collect()
    assert len(found) == 7 and all(r.ids == [] and r.decoded == "" for r in found if r.doc_id in (1, 2, 5))
    assert bpe.encode(none, WORDS).count() == 0


def test_bpe_scan_and_heap_agree():
    encoder = bpe.load(WORDS)
    rng = random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 60))).encode()
        ids = [*(encoder._inner[b] for b in raw[:-1]), encoder._last[raw[-1]]]
        assert encoder._merge_scanning(list(ids)) == encoder._merge_by_heap(list(ids))


def test_bpe_memo_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", 3)
    memo = bpe._Memo(lambda s: s.encode())
    assert [memo[x] for x in "abcabcdeab"] == [x.encode() for x in "abcabcdeab"] and len(memo) <= 3


# 10


def test_disguises_are_found_at_their_source():
    cases = {
        "mail john.doe [at] example [dot] com now": ("email", "john.doe [at] example [dot] com"),
        "write j at mail dot example dot org ok": ("email", "j at mail dot example dot org"),
        "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ hi": ("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "nаme@exаmple.com": ("email", "nаme@exаmple.com"),
        "call plus one five five five one two three four five six seven today": ("phone", "plus one five five five one two three four five six seven"),
        "from 192[.]168[.]1[.]1 on": ("ip", "192[.]168[.]1[.]1"),
        "card 4111​1111​1111​1111.": ("card", "4111​1111​1111​1111"),
    }
    for text, (kind, source) in cases.items():
        base, every = pii.all_spans(text)
        assert [text[a:b] for a, b in every[kind]] == [source] and not base[kind]
        assert all(not v for k, v in every.items() if k != kind)
    for text in ["look at example.com please", "the dot at one point in two or three", "un deux trois et un point", "", "one two"]:
        assert not any(pii.all_spans(text)[1].values())


def test_spelled_addresses_of_few_digits():
    cases = {
        "dns eight dot eight dot eight dot eight now": "eight dot eight dot eight dot eight",
        "host one zero dot zero dot zero dot one up": "one zero dot zero dot zero dot one",
        "an uno punto uno punto uno punto zwei zwei zwei da": "uno punto uno punto uno punto zwei zwei zwei",
    }
    for text, source in cases.items():
        base, every = pii.all_spans(text)
        assert [text[a:b] for a, b in every["ip"]] == [source] and not any(base.values())
        assert all(not v for k, v in every.items() if k != "ip")
    for text in ["One. Two. Three. Four.", "one dot two dot three", "one dot two dot three dot four dot five", "three point one four"]:
        assert not any(pii.all_spans(text)[1].values()), text


def test_plain_spans_are_the_patterns(spark, odd, none):
    from test_queries import brute_personal

    rng = random.Random(3)
    pieces = ["a", "@", "@", ".", "1", "25", "4111111111111111", " ", "-", "+", "(", "x.y", "é", "+1 555"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert pii.plain_spans(text) == brute_personal(text), text
    assert pii.plain_spans("1" * 200_000)["card"] == []  # in one pass, and no number of that length is ever made
    found = pii.find(odd).collect()
    assert len(found) == 7 and {r.spans for r in found} == {""}
    assert pii.find(none).count() == 0


# faults once found


def test_lines_of_documents_with_every_name_taken(spark):
    """Columns named like the helpers' own come back as they were."""
    line = "a line of forty code points or more, said by all of them"
    rows = [(i, f"{line}\nown {i}", "mine", "own", 7) for i in range(6)]
    found = linededup.drop_common_lines(spark.createDataFrame(rows, "doc_id bigint, text string, _thd string, _own string, _gone int"))
    assert {(r._thd, r._own, r._gone) for r in found.collect()} == {("mine", "own", 7)}
    assert sorted(r.text for r in found.collect())[0] == f"{line}\nown 5"


def test_quality_learns_one_text_of_an_id(spark):
    """An id repeated very often, with different texts, sends one row to the driver, the same in any order."""
    good = [(i, f"calm steady words about gardens and rivers number {i} " * 5) for i in range(20)]
    bad = [(100 + i, f"BUY!!! $$$ NOW {i} ### " * 9) for i in range(20)]
    again = [(3, f"other text {i % 7} of the same id") for i in range(5000)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id bigint, quality int")
    one = quality.fit(docs(spark, good + bad + again), labels)
    two = quality.fit(docs(spark, list(reversed(good + bad + again))).repartition(7), labels)
    assert one == two


def test_more_disguises_are_found():
    shown = {
        "mail john%40example.com now": "john%40example.com",
        "mail john&#64;example.com now": "john&#64;example.com",
        "mail john_at_example_dot_com now": "john_at_example_dot_com",
        "at 192。168。0。1 there": "192。168。0。1",
        "host 10 dot zero dot zero dot one up": "10 dot zero dot zero dot one",
    }
    for text, wanted in shown.items():
        base, every = pii.all_spans(text)
        spans = [text[a:b] for kind in every for a, b in every[kind] if (a, b) not in base[kind]]
        assert spans == [wanted], (text, spans)
    for text in ("look_at_this.now and 50%40", "5 dot three is a number", "rock &amp; roll_at_home"):
        base, every = pii.all_spans(text)
        assert base == every


def test_licences_of_another_catalogue(spark):
    """Common licences by default; a catalogue of one's own from tables; a control character in a text is a blank."""
    cases = {
        1: ("Licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0-only"]),
        2: ("// SPDX-License-Identifier: LGPL-2.1-only\nint x;", ["LGPL-2.1-only"]),
        3: ("Boost Software License - Version 1.0\n\nmore", ["BSL-1.0"]),
        4: ("Released under the MIT\u0001License.", ["MIT"]),
        5: ("This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose,\n"
            "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. ...", ["Zlib"]),
    }
    found = {r.doc_id: r.licences for r in licenses.scan(docs(spark, [(i, t) for i, (t, _) in cases.items()])).collect()}
    assert found == {i: want for i, (_, want) in cases.items()}
    sentences = spark.createDataFrame([("own-a", "House licence, part one."), ("own-b", "House licence, part two."), ("own-a", "House licence (first part).")], "sentence_id string, sentence string")
    rules = spark.createDataFrame([("House", ["own-a", "own-b"])], "licence string, sentence_ids array<string>")
    own = licenses.Catalogue.of_tables(sentences, rules)
    texts = [(1, "house LICENCE first part. House licence, part two."), (2, "House licence, part two. House licence, part one."), (3, "Released under the MIT License.")]
    found = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.scan(docs(spark, texts), catalogue=own).collect()}
    assert found == {1: (["own-a", "own-b"], ["House"]), 2: (["own-b", "own-a"], []), 3: ([], [])}
