"""Registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm import ann_tree, bpe, language_id, packing, phrases, quality_rules, quote_links, secret_scan, simhash, suffix_dedup, token_counts, token_links, warc
from reconlake.plans.lineage import importable

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
UNIGRAM = PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    left = F.make_valid_utf8(F.col("kept").cast("string"))  # U+FFFD for a character that lost some of its bytes
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("kept_bytes"), left.alias("text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score_units", "n_grams")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op4_ann_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(_table(spark, sf_dir, "embeddings"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), UNIGRAM)


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link(_table(spark, sf_dir, "conversations"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_links.align(_table(spark, sf_dir, "documents"), TOKENIZER, PIECES)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_quality_rules, op3_secret_scans, op4_ann_kmeans_tree, op5_warc_round_trip, op6_trie_token_counts, op7_quotation_linking, op8_bpe_round_trip, op9_best_fit_packing, op10_simhash_near_dedup, op11_language_id, op12_cross_tokenizer_alignment, op13_phrase_collocations)}

_WORDS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, p
    FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces)
"""

SQL: dict[str, str] = {
    "op13_phrase_collocations": _WORDS
    + """
, spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM words)
, phrases AS (
    SELECT lang, size, phrase, count(*) AS f
    FROM (SELECT lang, size, CASE WHEN k + size - 1 <= len(w) THEN array_to_string(w[k : k + size - 1], ' ') END AS phrase FROM spots, (SELECT unnest([1, 2, 3]) AS size))
    WHERE phrase IS NOT NULL GROUP BY ALL
)
, totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE size = 1 GROUP BY lang)
, candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1 AND f >= 10)
, cuts AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
    JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
)
, lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
, longer AS (
    SELECT lang, phrase, max(a) AS longer
    FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE size = 3)
    GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, b.l, b.r, t.n::BIGINT AS n, b.score::BIGINT AS score
    FROM lowest b JOIN totals t ON t.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
    WHERE NOT coalesce(100 * g.longer >= 50 * b.a, false)
) WHERE rank <= 2000
"""
}
