"""Best-fit packing of token sequences, with lower bounds that certify the number of bins."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.bpe import _byte_letters, _first_points, _Memo, little_endian
from driftgate.llm.common import fresh, kept

PART_ROWS = 8192  # items that one task packs together, about
_STEPS = 24  # of the step functions among the bounds
_STRETCH = 1 << 20  # characters of a text that are encoded at a time

#: Byte-level splitting never joins what stands before such a space to what follows, whatever stands before it.
_WORD_START = re.compile(r" (?=[!-~À-ɏ])")
_SPACE = r"\t-\r \x85\xa0"
#: White space, letters and numbers below this never change their kind, so the file's own cuts can be made here.
_LATIN = re.compile("[\x00-\u024f]*")


class ByteBpe:
    """Ids of the tokenizers library, which is asked once for each word that was not seen lately.

    A text is first cut before spaces where the file's own expression always cuts. A stretch of Latin text is cut into the
    expression's words, and the library's model gives the ids of those that are not in the memo. Any other stretch, and one
    with a special token, is cut before such spaces only, and the whole library gives the ids of the new parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._model = self.library.model
        letters, numbers = (_first_points(x) for x in "LN")
        self._words = re.compile(
            f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
        )
        self._letters = dict(enumerate(_byte_letters()))
        self._special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self._by_word, self._by_part = _Memo(self._word), _Memo(self._part)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._letters))]).tobytes()

    def _part(self, part: str) -> bytes:
        return array("I", self.library.encode_batch_fast([part], add_special_tokens=False)[0].ids).tobytes()

    def _stretch(self, text: str) -> bytes:
        if _LATIN.fullmatch(text) and not self._special.search(text):
            return b"".join(map(self._by_word.__getitem__, self._words.findall(text)))
        first, *others = _WORD_START.split(text)
        return self._by_part[first] + b"".join(self._by_part[" " + part] for part in others)

    def encode(self, text: str | None) -> array:
        """The ids of a text; a null one has none."""
        ids, at = array("I"), 0
        while text and at < len(text):
            cut = _WORD_START.search(text, at + _STRETCH) if len(text) - at > _STRETCH else None
            end = cut.start() if cut else len(text)
            ids.frombytes(self._stretch(text[at:end]))
            at = end
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(
    docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids binary]) of every document's ids with ``closing`` after them.

    Documents of more than ``capacity`` ids are cut into pieces of that length; only their first piece may be shorter. A
    null text counts as empty: one piece with the closing id alone. Each row is a document of its own, repeated ones too;
    a null id stays null and other columns are ignored. ``ids`` are little-endian unsigned 32-bit integers.
    """
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    extra = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                of, piece, start, length, crc, raw = [], [], [], [], [], []
                for row, text in enumerate(part.column(1)):
                    ids = bpe.encode(text.as_py())
                    ids.append(closing)
                    packed, n = little_endian(ids), len(ids)
                    cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        content = packed[4 * a : 4 * b]
                        of.append(row)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(content))
                        if with_ids:
                            raw.append(content)
                columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint{extra}")


def bound(counts: np.ndarray, capacity: int) -> Fraction:
    """A number of bins that no packing can go below, rounding left to the caller; ``counts`` by size from 0 to capacity.

    The largest sum of dual feasible functions: the sizes themselves, and steps of (k + 1) x / capacity, k up to a fixed
    number, each after a function that takes sizes below some e for nothing and sizes above capacity - e for whole bins.
    """
    counts = np.asarray(counts, np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    e = np.arange(capacity // 2 + 1)
    large = np.concatenate([[0], np.cumsum(counts[::-1])])[e]  # items above capacity - e
    best = Fraction(0)
    for k in range(_STEPS + 1):
        if k:
            steps = (k + 1) * size // capacity
            value, whole = np.where((k + 1) * size % capacity == 0, k * size, steps * capacity), k * capacity
        else:
            value, whole = size, capacity
        upto = np.concatenate([[0], np.cumsum(counts * value)])
        total = large * whole + upto[capacity - e + 1] - upto[e]
        best = max(best, Fraction(int(total.max()), whole))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, room left by bin) of items, largest first into the fullest bin that takes them.

    The rooms in use are the set bits of one integer, so the least room that is large enough is its lowest bit from there on.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[int] = []
    having: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        enough = rooms >> size
        if enough:
            left = size + (enough & -enough).bit_length() - 1
            at = having[left].pop()
            if not having[left]:
                rooms ^= 1 << left
        else:
            at, left = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = at, capacity - left
        room[at] = left = left - size
        if left:
            having[left].append(at)
            rooms |= 1 << left
    return bins, offsets, np.array(room, np.int64)


_STATE = "item bigint, size bigint, bin bigint, place bigint, room bigint, certified boolean, bins bigint"


def _packer(capacity: int, numbered):
    """Packs one group of items. The packing that came in stays if the new one has no fewer bins."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        sizes = rows["size"].to_numpy()
        bins, places, room = best_fit(sizes, capacity)
        names, rooms = numbered(rows, len(room)), room[bins]
        if names is None:  # no fewer
            number, places, rooms = rows["bin"].to_numpy(), rows["place"].to_numpy(), rows["room"].to_numpy()
            n = len(np.unique(number))
        else:
            number, n = names[bins], len(room)
        certified = n <= bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return pd.DataFrame({"item": rows["item"], "size": sizes, "bin": number, "place": places, "room": rooms, "certified": certified, "bins": n})

    return run


def pack(items: DataFrame, size: Column, capacity: int = 2048, part_rows: int = PART_ROWS, rounds: int = 8) -> DataFrame:
    """``items`` with sequence_id and offset: as few sequences of at most ``capacity`` as can be found, no gaps inside one.

    Items are dealt to parts of about ``part_rows`` and each part is packed best fit decreasing. A part whose bins meet its
    lower bound is certified. The others give the documents of their unfilled bins to an exchange, where filled bins that a
    hash draws make up the number: whole bins are dealt anew to parts of the same size and packed again, and a part keeps the
    new packing only if it has fewer bins, so no round makes anything worse. It ends when the bins meet the bound over all
    items, when two rounds in a row save nothing, or after ``rounds``. The driver holds counts by size, ``capacity`` of them
    at most.

    Every row is an item of its own, so repeated rows are packed each; sizes are 1 to ``capacity``, anything else is an
    error. No rows give no rows.
    """
    row, sequence, place = fresh(items, "item", "bin", "place")
    checked = F.when((size >= 1) & (size <= capacity), size.cast("bigint"))
    (wide,) = fresh(items, "size")
    # stored with its numbers, so that whatever is computed again sees the same ones
    rows = kept(items.withColumn(wide, F.coalesce(checked, F.raise_error(F.lit("a size outside 1 to capacity")).cast("bigint"))).withColumn(row, F.monotonically_increasing_id()))
    full = F.col(wide) == capacity
    smaller = rows.where(~full).select(F.col(row).alias("item"), F.col(wide).alias("size"))
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in smaller.groupBy("size").count().collect():
        counts[x] = n
    goal = -(-bound(counts, capacity) // 1)

    def dealt(parts: int, by: str, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), by), F.lit(parts))

    def first_names(group: pd.DataFrame, n: int) -> np.ndarray:
        return (int(group["part"].iloc[0]) << 32) + np.arange(n)

    def kept_names(group: pd.DataFrame, n: int) -> np.ndarray | None:
        known = np.unique(group["bin"].to_numpy())
        return known[:n] if n < len(known) else None

    parts = max(1, -(-int(counts.sum()) // part_rows))
    now = kept(smaller.withColumn("part", dealt(parts, "item", 0)).groupBy("part").applyInPandas(_packer(capacity, first_names), _STATE))
    used, total, idle = None, int(counts.sum()), 0
    for number in range(1, rounds + 1):
        if used is None:
            used = now.agg(F.count_distinct("bin")).first()[0]
        if used <= goal or idle == 2:
            break
        unfilled = ~F.col("certified") & (F.col("room") > 0)
        n = now.where(unfilled).count()
        parts = max(1, -(-n // part_rows))
        share = max(0, parts * part_rows - n) / max(total - n, 1)
        drawn = F.pmod(F.xxhash64(F.lit(-number), "bin"), F.lit(1 << 30)) < int(share * (1 << 30))
        moving = now.where(unfilled | drawn)
        before = moving.agg(F.count_distinct("bin")).first()[0]
        packed = kept(moving.withColumn("part", dealt(parts, "bin", number)).groupBy("part").applyInPandas(_packer(capacity, kept_names), _STATE))
        now = now.where(~(unfilled | drawn)).unionByName(packed)
        saved = before - packed.agg(F.count_distinct("bin")).first()[0]
        used -= saved
        idle = 0 if saved else idle + 1
    found = now.select(F.col("item").alias(row), (2 * F.col("bin")).alias(sequence), F.col("place").alias(place))
    columns = [F.col(c) for c in items.columns]
    alone = rows.where(full).select(*columns, (2 * F.col(row) + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return rows.where(~full).join(found, row).select(*columns, F.col(sequence).alias("sequence_id"), F.col(place).alias("offset")).unionByName(alone)
