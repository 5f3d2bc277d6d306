"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .arrow import table
from .audio import audio_digest
from .bytecnn import fit_quality, score_documents
from .crossparse import score_words
from .jaccard import near_duplicates
from .packing import packed_digest
from .pieces import round_trip
from .rules import BITS, KINDS, NgramModel, apply_rules, fit_rules
from .tokencache import count_tokens, fresh_cache
from .urls import fit_filter, judge_urls, ruled


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digest(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_words(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), fresh_cache(spark))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, fit_filter(pages))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express: host, path and rule."""
    return ruled(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.col("ruling").alias("verdict"))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: counts and base rules, which no model touches."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, NgramModel(np.zeros((KINDS, 1 << BITS), np.float32), 0.0)).drop("probability", "kept")


def audio_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express: what is stored and read back."""
    return op3_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def token_count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can express: sizes, and that no text has more tokens than bytes, nor none but where it is blank."""
    rows = op8_token_counts(spark, sf_dir)
    return rows.select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("fits"), (F.col("n_tokens") > 0).alias("some"))


PARTS = {
    "url_rules": """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, verdict, rule_host || rule_path AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS n FROM h, k WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND n = 1""",
    "base_counts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ 	-
]+') AS w FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "audio_payload": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS n FROM documents), p AS (SELECT *, greatest(192, (n + 191) // 192 * 192) AS payload FROM t)
SELECT doc_id, n AS n_bytes, payload AS payload_bytes, sha256(text || repeat(' ', payload - n)) AS payload_sha256 FROM p""",
    "token_count_bounds": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, true AS fits, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0 AS some FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_audio": op3_audio,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_quality_rules": op5_quality_rules,
        "op6_byte_cnn": op6_byte_cnn,
        "op7_cross_parsing": op7_cross_parsing,
        "op8_token_counts": op8_token_counts,
        "op9_url_filters": op9_url_filters,
        "op10_sentencepiece": op10_sentencepiece,
        "url_rules": url_rules,
        "base_counts": base_counts,
        "audio_payload": audio_payload,
        "token_count_bounds": token_count_bounds,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.ORACLE, **PARTS}
