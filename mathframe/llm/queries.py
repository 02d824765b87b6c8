"""Queries that apply the operators to their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embdedup, langid, linededup, mixing, pii, quality, simhash, tokencount, toxicity, winnowing
from .sampling import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, learned from two thirds of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 3) == 1
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn_from=~held_out)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_feistel(spark: SparkSession, sf_dir: str, key: str = "example key, to be replaced") -> DataFrame:
    """Every document with its personal data replaced by pseudonyms under a key."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, from its text, markup and address."""
    return langid.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnowing.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    n_items = F.size("hit_items").cast("bigint")
    return found.select("doc_id", "n_words", winnowing.hit_words().alias("n_hit"), n_items.alias("n_items"), winnowing.items_digest().alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from four fifths of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    net = quality.fit(docs, _table(spark, sf_dir, "labels"), learn_from=~held_out)
    return quality.score_quality(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Token counts of every document; the tokenizer file is a parameter."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokenizer_path).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op2_feistel": op2_feistel,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_winnowing": op5_winnowing,
    "op8_lattice": op8_lattice,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
}

_OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS weight FROM sources),
summed AS (
  SELECT *, CAST(3 * sum(source_size) OVER () AS HUGEINT) AS pot, CAST(sum(weight) OVER () AS HUGEINT) AS all_weight,
         CAST(coalesce(sum(source_size) OVER w, 0) AS HUGEINT) AS size_before, CAST(coalesce(sum(weight) OVER w, 0) AS HUGEINT) AS weight_before
  FROM ranked
  WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, CAST(source_size AS HUGEINT) * 4 * (all_weight - weight_before) < (pot - size_before * 4) * weight AS full_cap FROM summed),
levelled AS (
  SELECT source, source_size,
         CASE WHEN full_cap OR source_size = 0 THEN CAST(2 * source_size AS DOUBLE)
              ELSE least(CAST(weight * (pot - 4 * CAST(sum(CASE WHEN full_cap THEN source_size ELSE 0 END) OVER () AS HUGEINT)) AS DOUBLE)
                         / CAST(2 * (all_weight - CAST(sum(CASE WHEN full_cap THEN weight ELSE 0 END) OVER () AS HUGEINT)) AS DOUBLE),
                         CAST(2 * source_size AS DOUBLE)) END AS target
  FROM capped),
units AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, h),
running AS (
  SELECT source, h, words, CAST(sum(words) OVER (PARTITION BY source ORDER BY h) - words AS BIGINT) AS before FROM units),
plan AS (
  SELECT l.*, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM levelled l)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN 2 * r.before + r.words < 2 * (p.target - p.whole * p.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d
JOIN plan p ON p.source IS NOT DISTINCT FROM d.source
JOIN running r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h
"""

_OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(8, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM b))),
hits AS (SELECT dw.doc_id, dw.k, dw.s, bw.item FROM dw JOIN bw USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL = {"op4_mixing": _OP4_SQL, "op5_winnowing": _OP5_SQL}
