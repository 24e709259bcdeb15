"""The registered queries of the operators: production parameters, whole tables, whole results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import html, langid, lines, minhash, mixing, neighbours, packing, quality, runs, suffixes, topk, tries, warc
from runloom.llm.common import WORD, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tokenizer_path() -> str:
    """The tokenizer's file, as ``RUNLOOM_TOKENIZER`` names it or else from the public vocabulary files."""
    if named := os.environ.get("RUNLOOM_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op1_minhash_near_dedup")
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = html.extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


# every payload has at least 0 bytes, so the rule for smaller ones never applies here; the base32 text comes from the digest's bits
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(list_sum(list_transform(range(5),
    lambda j: CAST(bits[5*i+j+1] AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


@query("op4_warc", _WARC_SQL)
def warc_records(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, folder, "pages"))


@query("op5_mixing")
def mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op6_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out_fold(F.col("doc_id"))
    model = langid.learn(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_QUALITY_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM h WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN u ON w.doc_id = u.doc_id
"""
#: The base figures in SQL; the verdict's line rules are tested against a plain version instead.
BASE_SQL = {"op7_quality_rules": _QUALITY_SQL}


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, folder, "documents"))


@query("op8_suffix_array_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"), length=400).drop("kept")


_LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
"""


@query("op9_line_dedup", _LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


# crc32 bit by bit; turns as lists of structs; a node is a distinct prefix
_TRIE_SQL = """
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS l FROM t GROUP BY c),
h AS (SELECT c, l, xor(list_reduce(list_transform(range(length(c::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii((c::VARCHAR)[i]) END),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(o.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
p AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM b),
n AS (SELECT d, md5(l[1:d]::VARCHAR) AS id, CASE WHEN d > 0 THEN md5(l[1:d - 1]::VARCHAR) END AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(l[1:d]) AS l,
  any_value(CASE WHEN d > 0 THEN length((l[d]).x) ELSE 0 END) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends
  FROM p GROUP BY 1, 2, 3),
k AS (SELECT d - 1 AS d, up AS id, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON n.d = k.d AND n.id = k.id),
a AS (SELECT a AS d, md5(l[1:a]::VARCHAR) AS id, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN a ON m.d = a.d AND m.id = a.id LEFT JOIN n u ON u.d = m.d - 1 AND u.id = m.up
"""


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    heads = turns.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    own = turns.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("from"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return own.join(heads, F.col("from") == F.col("base"), "left").select("conv_id", F.concat(head, rest).alias("turns"))


@query("op11_prefix_trie", _TRIE_SQL)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.prefix_trie(rebuilt_turns(tries.conversation_turns(table(spark, folder, "conversations"))))


def repeating_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by crc32, the words from g % n on repeat with a period that fits 3 to 10 times."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(hashed % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    own = docs.select("doc_id", "text", words.alias("w"), F.floor(hashed / 10).alias("g")).withColumn("n", F.size("w"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    own = own.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    text = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return own.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse_runs(repeating_texts(table(spark, folder, "documents")))


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op13_exact_top_k", _TOPK_SQL)
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_inner_products(table(spark, folder, "embeddings"))
