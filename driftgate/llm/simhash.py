"""Near-duplicates by SimHash, found through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import fresh, kept
from driftgate.llm.components import components

SEED = 42
MOST_DIFFERING = 4
_GENERATOR, _PARITY, _LENGTH = 0b101011100011, 11, 23  # of the perfect binary Golay code
_BLOCK = 1 << 16
_KINDS = 5  # of keys

# fingerprints


def fingerprint(text: str | None, words: int, seed: int = SEED) -> int:
    """64 majority bits over the hashes of all word shingles; zero without words."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1]
    ends = ends[words - 1 :] - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        bounds = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in bounds), np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) per row, fp as a signed 64-bit number, th a hash of the text.

    Null and word-less texts have fingerprint zero.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = np.fromiter((fingerprint(x.as_py(), words, SEED) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=[id_col, "th", "fp"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['_id'].dataType.simpleString()}, th bigint, fp bigint")


# Golay keys


def _remainder(value: int) -> int:
    for bit in range(_LENGTH - 1, _PARITY - 1, -1):
        if value >> bit & 1:
            value ^= _GENERATOR << (bit - _PARITY)
    return value


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the upper 12 bits, and the error patterns of up to four bits of each syndrome, -1 where there are no more."""
    syndromes = np.array([_remainder(x << _PARITY) for x in range(1 << (_LENGTH - _PARITY))], np.int64)
    patterns = np.full((1 << _PARITY, 6), -1, np.int64)
    filled = [0] * (1 << _PARITY)
    one = [_remainder(1 << bit) for bit in range(_LENGTH)]
    for errors in range(5):
        for bits in combinations(range(_LENGTH), errors):
            syndrome = 0
            for bit in bits:
                syndrome ^= one[bit]
            patterns[syndrome, filled[syndrome]] = sum(1 << bit for bit in bits)
            filled[syndrome] += 1
    return syndromes, patterns


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within four bits of each 23-bit word: one or six a row, -1 for none.

    Two words that differ in at most two bits have an index in common. (With a parity bit added, the word is at an even
    distance from all codewords, and either at 2 or less from one, or at exactly 4 from six of them, which split the 24
    positions into six fours; changing two positions stays within one of these fours or moves one four onto another.)
    """
    syndromes, patterns = _tables()
    errors = patterns[syndromes[words >> _PARITY] ^ (words & ((1 << _PARITY) - 1))]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> _PARITY)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for unsigned 64-bit fingerprints: two that differ in at most four bits have a key in common.

    The fingerprint is cut into A and B of 23 bits and C of 18. If A or B is equal, that is the key. Otherwise both
    differ; if each differs in at most two bits, they share a pair of codeword indices; and if one differs in three, the
    other differs in one and C is equal, so C and a codeword index of the other are shared.
    """
    a = (fps & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fps >> np.uint64(46)).astype(np.int64)
    near_a, near_b = golay_indices(a), golay_indices(b)
    pairs = ((near_a[:, :, None] << 12 | near_b[:, None, :]) | 2 << 32).reshape(len(fps), -1)
    known = ((near_a >= 0)[:, :, None] & (near_b >= 0)[:, None, :]).reshape(len(fps), -1)
    keys = np.concatenate([a[:, None], b[:, None] | 1 << 32, pairs, c[:, None] << 12 | near_a | 3 << 32, c[:, None] << 12 | near_b | 4 << 32], axis=1)
    on = np.concatenate([np.ones((len(fps), 2), bool), known, near_a >= 0, near_b >= 0], axis=1)
    rows, columns = np.nonzero(on)
    return rows, keys[rows, columns]


def with_keys(fps: DataFrame) -> DataFrame:
    """Rows of ``fps`` (bigint columns, fp among them), once for each key of their fingerprint."""
    names = fps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                values = [part.column(i).to_numpy() for i in range(len(names))]
                rows, keys = golay_keys(values[names.index("fp")].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(v[rows]) for v in values)], names=["key", *names])

    return fps.mapInArrow(run, "key bigint, " + ", ".join(f"{n} bigint" for n in names))


# links


def _close(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= most


def linked(fps: DataFrame, most_differing: int = MOST_DIFFERING) -> DataFrame:
    """(node, root) for each fingerprint that links to another one; ``fps`` has each value once.

    First, every key's rows are compared with its smallest and its largest fingerprint only: large families of near
    copies become few components, with as many rows as there are keys. Then all rows of a key are compared, but only
    rows of different components come out, so that no link is lost and a family's pairs are not all written.
    """
    fps = fps.select("fp")
    keys = with_keys(fps)
    ends = keys.groupBy("key").agg(F.min(F.struct("fp")).alias("lo"), F.max(F.struct("fp")).alias("hi")).where("lo < hi")
    met = keys.join(ends, "key")
    stars = [met.where(_close("", f"{end}.", most_differing)).select(F.col("fp").alias("u"), F.col(f"{end}.fp").alias("v")) for end in ("lo", "hi")]
    first = kept(components(stars[0].unionByName(stars[1]).where("u <> v").distinct()))
    named = fps.withColumn("node", F.col("fp")).join(first, "node", "left").select("fp", F.coalesce("root", "node").alias("label"))
    all_keys = with_keys(kept(named))
    left, right = ((all_keys.select(*(F.col(c).alias(f"{side}_{c}") for c in all_keys.columns))) for side in "ab")
    same_key = (F.col("a_key") == F.col("b_key")) & (F.col("a_label") < F.col("b_label"))
    across = left.join(right, same_key & _close("a_", "b_", most_differing))
    second = components(across.select("a_label", "b_label").distinct(), "a_label", "b_label")
    second = second.select(F.col("node").alias("label"), F.col("root").alias("top"))
    joined = first.select("node", F.col("root").alias("label"))
    # a fingerprint may have been alone in the first round and linked in the second
    alone = second.select(F.col("label").alias("node"), "label").join(joined.select("node"), "node", "left_anti")
    return joined.unionByName(alone).join(second, "label", "left").select("node", F.coalesce("top", "label").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, most_differing: int = MOST_DIFFERING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp, root, component_id) per row: component_id is the smallest id that the row's fingerprint reaches.

    Texts are lower-cased (A-Z), split at ASCII white space and hashed in shingles of ``words`` words, repeats included.
    Fingerprints link at ``most_differing`` bits or fewer; equal ones (copies, and all texts without words, null ones
    included) always do. Up to four bits, no link is missed.

    root names the component. Ids are bigints; a null id takes part and never names a component, unless all ids are
    null. Repeated rows stay repeated. Other columns are ignored. No rows give no rows.
    """
    if not 0 <= most_differing <= MOST_DIFFERING:
        raise ValueError(f"the keys find all pairs with up to {MOST_DIFFERING} differing bits")
    marks = kept(fingerprints(docs, words, id_col, text_col))
    node = F.col("fp")
    fps = kept(marks.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = linked(fps, most_differing)
    nodes = fps.select(node.alias("node"), "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    nodes = kept(nodes)
    # both stored, so that the joins have a shuffle of their own on either side, which Spark splits where a group is large
    named = kept(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    known = kept(nodes.join(named, "root").select(F.col("node").alias("_node"), "root", "component_id"))
    return marks.join(known, node == F.col("_node")).select(id_col, "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, most_differing: int = MOST_DIFFERING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, one row of each component of ``near_duplicates``: the one with the smallest id.

    Null ids come last. Of rows that repeat the chosen id and text, one stays. No rows give no rows.
    """
    groups = near_duplicates(docs, words, most_differing, id_col, text_col)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "th")).alias("chosen"))
    first = kept(first.select(F.col("chosen.id").alias("_chosen_id"), F.col("chosen.th").alias("_chosen_th")))
    (digest,) = fresh(docs, "th")
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    found = marked.join(first, marked[id_col].eqNullSafe(first["_chosen_id"]) & (marked[digest] == first["_chosen_th"]), "left_semi")
    return found.dropDuplicates([id_col, digest]).select(*docs.columns)
