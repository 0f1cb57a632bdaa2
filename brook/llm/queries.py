"""Registered queries of the training-data operators.

Each applies an operator, with production parameters, to its whole table and
derives the contract's columns from the operator's own result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brook.llm import (
    chats,
    collocations,
    embeddings,
    licenses,
    lines,
    negatives,
    packing,
    pii,
    quality,
    sentencepieces,
    shards,
    simhash,
    substrings,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f
    return put


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _hex(binary_or_text: str):
    return F.sha2(binary_or_text, 256)


@register("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentencepieces.encode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(F.col("doc").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), _hex("decoded").alias("decoded_sha256"))


# The rules by hand: words, lines and 8-word windows of each text, failures by
# source, the beta prior by moments, and the verdict: not trusted if three
# deviations below its rate a source's odds are still over twice the corpus's.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1)::BIGINT)) AS i FROM w)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
r AS (
  SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > n_words OR 10 * (len(ls) - len(list_distinct(ls))) > 3 * len(ls)
           OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS soft FROM m),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS f FROM r WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT avg(f / n) AS m, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS v, sum(f) / sum(n) AS c FROM hosts),
p AS (SELECT m, c, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000000) ELSE 1000000 END AS k FROM s),
rates AS (SELECT source, c, (m * k + f) / (k + n) AS rate, k + n + 1 AS w FROM hosts, p),
low AS (SELECT source, c, rate - 3 * sqrt(rate * (1 - rate) / w) AS low FROM rates),
verdicts AS (SELECT source, NOT low * (1 - c) > 2 * c * (1 - low) AS ok FROM low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (coalesce(ok, true) OR NOT soft) AS kept
FROM r LEFT JOIN verdicts USING (source)
"""


@register("op2_quality_hosts", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_verdicts(_documents(spark, sf_dir))
    return got.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


@register("op3_line_alignment")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.drop_common_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", F.col("n_cut_lines").cast("long").alias("n_cut_lines"), _hex("text").alias("kept_sha256"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(F.array(*[F.lit(k) for k in pii.KINDS]), x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


@register("op4_pii_trees")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(_documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return got.select(F.col("doc").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
                      F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                      _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


@register("op5_vector_forest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = embeddings.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return got.select(F.col("vec").alias("vec_id"), "n_links", "component_id",
                      F.col("vec").eqNullSafe(F.col("component_id")).alias("kept"))


def _tree(docs: DataFrame) -> DataFrame:
    """Documents laid out as a source tree: source / language / thousand / two
    hundred by id; those with a licence passage stand for licence files."""
    number = F.col("doc_id").cast("long")
    name = F.when(F.col("text").rlike(licenses.CUES), F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(number, F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.floor(number / 1000).cast("string"),
                                                     F.floor(number / 200).cast("string"), name).alias("path"))


@register("op6_licences")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(_tree(_documents(spark, sf_dir)))
    return got.select(F.col("doc").alias("doc_id"), "path", "own_licence", "cosine", "licence", "inherited_from")


@register("op7_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shards.shard(_documents(spark, sf_dir), 24)
    return got.select(F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_groups(_documents(spark, sf_dir))
    return got.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
                       like_col="lang")
    return got.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i+49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1)::BIGINT)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM windows) WHERE f < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM later) GROUP BY doc_id),
kept AS (
  SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(coalesce(ps, []), i)) AS stay
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(stay))::BIGINT AS n_removed,
       sha256(array_to_string(list_select(ws, stay), ' ')) AS kept_sha256
FROM kept
"""


@register("op10_de_bruijn", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.drop_repeated_windows(_documents(spark, sf_dir))
    return got.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", _hex("kept_text").alias("kept_sha256"))


OP11_SQL = r"""
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 10
"""


@register("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
    return got.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
                      F.col("negative").alias("negative_id"), "positive_score", "negative_score")


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(ws[i:i+m-1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, t.n::BIGINT AS n,
         (1000::HUGEINT * c.a * t.n::HUGEINT // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k+1:], ' ') JOIN total t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, n, array_to_string(ws[i:i+h-1], ' ') AS phrase
  FROM (SELECT lang, n, m, h, ws, unnest(range(1, m - h + 2)) AS i
        FROM (SELECT lang, n, m, string_split(phrase, ' ') AS ws, unnest(range(2, m)) AS h FROM f WHERE m > 2))),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM scored s JOIN parts p ON p.lang = s.lang AND p.phrase = s.phrase AND 100 * p.n >= 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored ANTI JOIN covered USING (lang, phrase)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@register("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = collocations.collocations(_documents(spark, sf_dir))
    return got.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# Formatted length: per turn the template's 14 characters, role, text, and a
# backslash for each control string.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(text) + len(regexp_extract_all(text, '(?m)^\\*### |\\*</turn>')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@register("op13_chats", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chats.read_back(chats.format_chats(turns.unionByName(more))).withColumnRenamed("conv", "conv_id")
