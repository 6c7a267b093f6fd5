"""The registered queries: against SQL where there is some, else against plain Python, over the whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import verify
import xxhash

from driftgate.llm.queries import ORACLE, QUERIES, tokenizer


@pytest.fixture(scope="module")
def con(sf):
    return verify.connect(sf)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def result(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, con, name):
    same, note = verify.compare(spark, con, name, sf)
    assert same, note


def test_every_operator_has_its_query():
    assert {re.match(r"op(\d+)_", name)[1] for name in QUERIES} == {str(n) for n in range(1, 14)}


def test_quality_on_held_out_rows(spark, con):
    folder = "/root/testdata/sf0.01"
    rows = result(spark, folder, "op1_quality")
    labels = dict(verify.connect(folder).execute("SELECT doc_id, quality FROM labels").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def brute_fingerprint(text, k):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, sf, texts):
    prints = {i: brute_fingerprint(t, 4) for i, t in texts.items()}
    roots = brute_components(prints, 4)
    rows = result(spark, sf, "op2_simhash")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{prints[i]:016x}", roots[i]) for i in texts}
    assert len(set(roots.values())) < len(roots)


def test_neighbours(spark, sf, con):
    vectors = dict(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids], float)
    found = {}
    for r in result(spark, sf, "op3_neighbours"):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for query, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and query not in {r.vec_id for r in rows}
        scores = matrix @ np.array(vectors[query], float)
        assert all(abs(r.score - scores[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        best = [i for _, i in sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != query)[:20]]
        hits += len(set(best) & {r.vec_id for r in rows})
    assert hits / (20 * len(found)) >= 0.9


def test_token_counts(spark, sf, texts):
    from driftgate.llm.token_scan import byte_pairs

    encode = byte_pairs(tokenizer("byte_bpe_50k.tiktoken"))
    assert {(r.doc_id, r.n_tokens) for r in result(spark, sf, "op4_token_counts")} == {(i, len(encode(t))) for i, t in texts.items()}


def test_language_on_held_out_rows(spark, con):
    folder = "/root/testdata/sf0.01"
    langs = dict(verify.connect(folder).execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = result(spark, folder, "op6_language")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_bpe_is_the_library_s(spark, sf, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = set()
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result(spark, sf, "op9_bpe")} == want


def brute_personal(text):
    def luhn(digits):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    def ok(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return {kind: [m.span() for m in re.finditer(p, text or "") if ok(kind, m[0])] for kind, p in patterns.items()}


def test_personal_data(spark, sf, texts):
    rows = {r.doc_id: r for r in result(spark, sf, "op10_personal_data")}
    assert set(rows) == set(texts)
    total = 0
    for i, text in texts.items():
        spans = brute_personal(text)
        base = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
        total += sum(map(len, spans.values()))
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(map(len, spans.values()))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    assert total > 0
