"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm import ann, bpe, langid, lexical, licenses, linededup, packing, pii, prefixes, quality, simhash, token_scan, winnow
from driftgate.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_bpe")
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, most_differing=4)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query(
    "op7_decontamination",
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
                FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM sized)),
    seen AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
             FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
                   FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, item_id, p, n FROM seen JOIN windows USING (n, win)),
    places AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS x FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query(
    "op8_line_dedup",
    r"""
    WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, pos, parts[pos] AS line,
                     translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
              FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS pos FROM cut)),
    common AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    marked AS (SELECT lines.*, common.key IS NOT NULL AND doc_id <> last AS gone FROM lines LEFT JOIN common USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = linededup.drop_common_lines(docs, min_chars=40, min_docs=5, lines_col="n_lines", dropped_col="n_dropped")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


@query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels").where(fold("doc_id", 4) != 2))
    found = quality.scores(docs, model, threshold=0.7)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_scan.token_counts(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"), separator=50256)


@query("op5_licences", licenses.oracle())
def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("bigint").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentences"),
        F.array_join("licences", ",").alias("licences"),
    )


@query("op11_packing")
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, closing=0)
    return packing.pack(cut, F.col("length"), capacity=2048)


@query(
    "op12_prefix_trie",
    r"""
    WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
                  FROM conversations WHERE conv_id IS NOT NULL),
    digits AS (SELECT i AS x, list_reduce(list_prepend(i::BIGINT, generate_series(1, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t
               FROM range(256) AS r(i)),
    lookup AS (SELECT list(t ORDER BY x) AS t FROM digits),
    every AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                                  lambda c, o: xor(t[(xor(c, o) & 255) + 1], c >> 8)), 4294967295) % 9 AS h
              FROM (SELECT DISTINCT conv_id FROM told), lookup),
    mixed AS (SELECT c.conv_id, 0 AS part, b.place, b.role, b.text FROM every c JOIN told b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.place < c.h
              UNION ALL
              SELECT c.conv_id, 1, o.place, o.role, o.text FROM every c JOIN told o ON o.conv_id = c.conv_id AND o.place >= c.h),
    turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, sha256(length(role) || ':' || role || text) AS d, strlen(text) AS bytes FROM mixed),
    lists AS (SELECT conv_id, list(d ORDER BY depth) AS ds FROM turns GROUP BY conv_id),
    begun AS (SELECT conv_id, 0 AS depth, '' AS k, 0 AS bytes FROM every
              UNION ALL
              SELECT conv_id, depth, array_to_string(ds[1:depth], ' '), bytes FROM turns JOIN lists USING (conv_id)),
    sizes AS (SELECT conv_id, max(depth) AS size FROM begun GROUP BY conv_id),
    nodes AS (SELECT depth, k, min(b.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                     coalesce(string_agg(b.conv_id::VARCHAR, ',' ORDER BY b.conv_id) FILTER (WHERE size = depth), '') AS ids
              FROM begun b JOIN sizes USING (conv_id) GROUP BY depth, k),
    up AS (SELECT n.*, p.conv_id AS parent_conv_id, p.k AS parent_k
           FROM nodes n LEFT JOIN begun x ON x.conv_id = n.conv_id AND x.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = x.depth AND p.k = x.k),
    children AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL),
    full_ AS (SELECT up.*, coalesce(n, 0) AS n_children FROM up LEFT JOIN children USING (depth, k)),
    trees AS (SELECT a.depth, a.k, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
              FROM full_ f JOIN begun a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.k)
    SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
           saved::BIGINT AS saved_tokens, sha256(ids) AS ends_sha256
    FROM full_ JOIN trees USING (depth, k)
    """,
)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(*prefixes.rebuilt(table(spark, folder, "conversations")))


@query(
    "op13_lexical",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL),
    total AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
    times AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
    weights AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM times, total GROUP BY t, n_docs),
    scores AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
               FROM times JOIN i USING (t) JOIN weights USING (t), total WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
    """,
)
def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)
