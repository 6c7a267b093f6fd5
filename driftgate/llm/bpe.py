"""Byte-pair encoding and decoding with a contiguous rank array per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the tokenizer's regular expressions see it.
_SPACE = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NO_RANK = 1 << 60
_SHORT = 96  # symbols; a longer word takes a heap instead of repeated scans
_MEMO = 1 << 18  # entries of a generation; two are kept


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _first_points(major: str) -> str:
    """The code points below U+0250 whose general category starts with ``major``, for a character class."""
    return "".join(f"\\u{x:04x}" for x in range(0x250) if unicodedata.category(chr(x))[0] == major)


class _Memo(dict):
    """Packed ids by string, filled on first use.

    When full, what was not asked for since the last time is forgotten. Long strings are never kept.
    """

    def __init__(self, make):
        self._make, self._old = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self._old.get(key)
        if ids is None:
            ids = self._make(key)
            if len(key) > _SHORT:
                return ids
        if len(self) >= _MEMO:
            self._old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class WordBpe:
    """Word-level BPE read from a tokenizer file: lower case, white space dropped, a suffix on each word's end.

    The file's special tokens are found in the raw text first, as the library does by default. A text of white
    space only, or an empty one, has no tokens.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("a BPE file with plain special tokens is expected")
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = _byte_letters()
        self._inner = [vocab.get(x) for x in letters]
        self._last = [vocab.get(x + suffix) for x in letters]
        self._merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern.replace(r"\s", _SPACE))
        self._spaces = regex.compile(f"[{_SPACE}]+")
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._controls = regex.compile("[\x1c-\x1f]")
        # up to this letter the categories never change, and Python's own expressions are faster
        letters, numbers = (_first_points(x) for x in "LN")
        self._latin = re.compile("[\x00-\u024f]*")
        self._latin_words = re.compile(
            pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\s\p{L}\p{N}", f"{_SPACE}{letters}{numbers}")
        )
        self._chunks, self._by_word = _Memo(self.chunk), _Memo(self.word)

    # one word

    def _merge_scanning(self, ids: list[int]) -> list[int]:
        """Ids of the parts and ranks of adjacent parts side by side; the smallest rank, leftmost first, is merged."""
        merges, none = self._merges, (_NO_RANK, -1)
        ranks = [merges.get(pair, none)[0] for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NO_RANK:
                break
            i = ranks.index(best)
            ids[i] = merges[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), none)[0]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), none)[0]
        return ids

    def _merge_by_heap(self, ids: list[int]) -> list[int]:
        """The same merges for a long word in n log n: a heap of (rank, position) over linked parts."""
        merges, n = self._merges, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if not alive[i] or ids[i] != left or (j := after[i]) >= n or ids[j] != right:
                continue
            ids[i], alive[j] = merges[left, right][1], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (found[0], h, ids[h], ids[i]))
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def word(self, word: str) -> bytes:
        raw = word.encode()
        ids = [x for x in [*(self._inner[b] for b in raw[:-1]), self._last[raw[-1]]] if x is not None]
        return array("I", self._merge_scanning(ids) if len(ids) <= _SHORT else self._merge_by_heap(ids)).tobytes()

    # whole texts

    def chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two white spaces, packed; words never reach across white space."""
        words = (self._latin_words if self._latin.fullmatch(chunk) else self._words).findall(chunk)
        return self.word(words[0]) if len(words) == 1 else b"".join(map(self._by_word.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        # each letter by itself, so a capital sigma at a word's end becomes the same small one as elsewhere
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # split() also parts at four control characters that are no white space here
        chunks = self._spaces.split(text) if self._controls.search(text) else text.split()
        return b"".join(map(self._chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> array:
        ids = array("I")
        if text:
            for part in self._specials.split(text) if "<|" in text else (text,):
                if part in self.special:
                    ids.append(self.special[part])
                else:
                    ids.frombytes(self._plain(part))
        return ids

    def decode(self, ids: array) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def little_endian(ids: array) -> bytes:
    if ids.itemsize != 4:
        raise RuntimeError("unsigned int is not 32 bits here")
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids and the decoded text of every row: id, ids array<bigint>, n_tokens, ids_sha256, decoded, decoded_sha256.

    One row per input row, so repeated rows stay repeated; a null text counts as empty: no ids, decoded "". A null id
    stays null; other columns are ignored. ``with_ids=False`` leaves out ids and decoded where only digests are wanted.
    """
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<bigint>, decoded string"
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):  # few rows at a time: ids of whole texts are large
                part = batch.slice(begin, 256)
                counts, digests, back, all_ids, texts = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(little_endian(ids)).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids.tolist())
                        texts.append(decoded)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {id_type}, {schema}")
