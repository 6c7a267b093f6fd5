"""Benchmark decontamination by winnowing: shared fingerprints are joined and extended to whole windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import ascii_lower, kept

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE = 30  # low bits of a packed fingerprint: its place in the text; the bits above are the hash
_BITS = 20  # of the filter over the benchmark's hashes, so its size is the same for any benchmark
_SMALL_ROWS = 200_000  # benchmark fingerprints that are broadcast; more are joined by a shuffle


def words_of(text: Column) -> Column:
    """Words of digits, letters a-z and everything beyond ASCII, after A-Z are lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: bound as a lambda's variable, the optimiser can't copy it into loops."""
    return F.get(F.transform(F.array(value), body), 0)


def _grams(hashes: Column, k: int) -> Column:
    """Hash (upper bits) and place (lower bits) of every run of k words; none if there are fewer words."""
    mask = F.lit(-(1 << _PLACE))

    def packed(i: Column) -> Column:
        return F.xxhash64(*(F.get(hashes, i + j) for j in range(k))).bitwiseAND(mask).bitwiseOR(i.cast("bigint"))

    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), packed)).otherwise(
        F.array().cast("array<bigint>")
    )


def winnowed(hashes: Column, k: int, span: int) -> Column:
    """The smallest k-gram, the leftmost of equal ones, of every window of span - k + 1 k-grams.

    ``hashes`` is bound (a column or a lambda's variable), for it is read in loops.
    Two texts that share ``span`` words or more share one of these hashes, at the same place in the shared words.
    """
    width = span - k + 1
    if width == 1:
        return _grams(hashes, k)

    def minima(grams: Column) -> Column:
        def least(i: Column) -> Column:
            return F.least(*(F.get(grams, i + j) for j in range(width)))

        starts = F.sequence(F.lit(0), F.size(grams) - width)
        return F.when(F.size(grams) >= width, F.array_distinct(F.transform(starts, least))).otherwise(F.array().cast("array<bigint>"))

    return _let(_grams(hashes, k), minima)


def _context(words: Column, place: Column, k: int, span: int) -> list[Column]:
    """The k words at ``place``, and as many words before (nearest first) and after as a window can reach."""
    reach = span - k
    first = F.greatest(place - reach, F.lit(0))
    return [
        F.slice(words, place + 1, k).alias("gram"),
        F.reverse(F.slice(words, first + 1, place - first)).alias("before"),
        F.slice(words, place + k + 1, reach).alias("after"),
    ]


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")


def _fingerprints(span: int, k: int, words: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Structs of span, k, hash, place and context of the winnowed k-grams that ``wanted`` lets through."""

    def of(found: Column) -> Column:
        chosen = _let(F.transform(found, lambda w: F.xxhash64(w)), lambda hashes: winnowed(hashes, k, span))
        if wanted is not None:
            chosen = F.filter(chosen, wanted)
        return F.transform(
            chosen,
            lambda v: F.struct(
                F.lit(span).alias("span"),
                F.lit(k).alias("k"),
                F.shiftrightunsigned(v, _PLACE).alias("hash"),
                _place(v).alias("place"),
                *_context(found, _place(v), k, span),
            ),
        )

    return _let(words, of)


def _leading(a: Column, b: Column) -> Column:
    """How many words two lists have in common from their beginning on."""
    return _let(
        F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        lambda same: F.when(F.array_contains(same, False), F.array_position(same, False).cast("int") - 1).otherwise(F.size(same)),
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What documents and benchmark items share, as two tables.

    rows: (id, th, n_words), one per row of ``docs``; th is a hash of the text, which tells rows of one id apart.
    hits: (id, th, places, items), one per pair of id and th with a hit: the sorted places of hit words, and the item ids.

    A window is ``window`` consecutive words of an item, or all words of an item with fewer. Every word of a document
    inside an occurrence of a window is hit. Nothing is missed: winnowed fingerprints of k words meet in every shared
    window, and each meeting is extended over the words themselves. Null texts have no words; items with a null id or
    without words take no part. A null document id is a document of its own.
    """
    small = benchmark.select(benchmark[item_col].alias("item"), words_of(benchmark[item_text_col]).alias("words"))
    small = kept(small.where("item is not null and size(words) > 0").distinct())
    lengths = sorted(r[0] for r in small.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect())  # at most `window` numbers
    kinds = [(n, min(k, n)) for n in lengths]

    source = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th"), words_of(docs[text_col]).alias("words"))
    if not kinds:
        rows = source.select("id", "th", F.size("words").cast("bigint").alias("n_words"))
        none = rows.where("false").select("id", "th", F.array().cast("array<int>").alias("places"), F.array().cast(f"array<{small.schema['item'].dataType.simpleString()}>").alias("items"))
        return rows, none

    parts = [
        small.where(F.least(F.size("words"), F.lit(window)) == n).select("item", F.explode(_fingerprints(n, kk, F.col("words"))).alias("f"))
        for n, kk in kinds
    ]
    prints = parts[0]
    for part in parts[1:]:
        prints = prints.unionByName(part)
    prints = kept(prints.select("item", "f.*"))

    slot = F.col("hash").bitwiseAND(F.lit((1 << _BITS) - 1))
    filled = prints.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")
    )
    filter_words = [0] * (1 << (_BITS - 6))
    for word, bits in filled.collect():  # at most 2^14 rows, whatever the benchmark's size
        filter_words[word] = bits
    bitmap = F.split(F.lit(",".join(map(str, filter_words))), ",").cast("array<bigint>")

    def wanted(v: Column) -> Column:
        at = F.shiftrightunsigned(v, _PLACE).bitwiseAND(F.lit((1 << _BITS) - 1))
        return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    found = F.flatten(F.array(*(_fingerprints(n, kk, F.col("words"), wanted) for n, kk in kinds)))
    base = kept(source.select("id", "th", F.size("words").cast("bigint").alias("n_words"), found.alias("found")))
    rows = base.select("id", "th", "n_words")

    candidates = base.select("id", "th", F.explode("found").alias("f")).select("id", "th", "f.*")
    known = prints.select("item", "span", "k", "hash", *(F.col(c).alias(f"item_{c}") for c in ("gram", "before", "after")))
    if prints.count() <= _SMALL_ROWS:
        known = F.broadcast(known)
    met = candidates.join(known, ["span", "k", "hash"]).where("gram = item_gram")
    met = met.select("id", "th", "item", "span", "k", "place", _leading(F.col("before"), F.col("item_before")).alias("l"), _leading(F.col("after"), F.col("item_after")).alias("r"))
    met = met.where("l + k + r >= span")
    hits = met.groupBy("id", "th").agg(
        F.collect_set(F.struct((F.col("place") - F.col("l")).alias("a"), (F.col("place") + F.col("k") - 1 + F.col("r")).alias("b"))).alias("ranges"),
        F.collect_set("item").alias("items"),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("ranges", lambda x: F.sequence(x["a"], x["b"])))))
    return rows, kept(hits.select("id", "th", places.alias("places"), "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, places, items (as strings, sorted), contaminated. See ``matches``.

    Repeated rows stay repeated; other columns of either table are ignored; no rows give no rows, and an empty benchmark
    hits nothing.
    """
    rows, hits = matches(docs, benchmark, window, k, id_col, text_col, item_col, item_text_col)
    hits = hits.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "places", "items")
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    items = F.array_sort(F.transform(F.coalesce("items", F.array().cast(hits.schema["items"].dataType)), lambda x: x.cast("string")))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("places", F.array().cast("array<int>")).alias("places"),
        items.alias("items"),
        F.col("places").isNotNull().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, without the rows that hold a window of the benchmark."""
    _, hits = matches(docs, benchmark, window, k, id_col, text_col, item_col, item_text_col)
    hits = hits.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"))
    th = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(hits, docs[id_col].eqNullSafe(hits["hit_id"]) & (th == hits["hit_th"]), "left_anti")
