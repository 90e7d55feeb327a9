"""The registered queries of the corpus operators, with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, exact_dedup, html_extract, line_dedup, minhash, mixing, preference, quality_rules, secrets_scan
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id NULLS LAST)
"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary(), digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_left")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preference.conversations_of(table(spark, sf_dir, "conversations"))
    return preference.digest(preference.format_pairs(preference.other_answers(convs)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
last AS (SELECT conv_id, max(k) AS last_k FROM t WHERE role = 'assistant' GROUP BY conv_id),
answers AS (SELECT conv_id, last_k, text AS answer FROM t JOIN last USING (conv_id) WHERE k = last_k),
pairs AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.last_k, b.answer FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1)),
turns AS (SELECT chosen_id, rejected_id, k, role, text, CASE WHEN k = last_k THEN answer ELSE text END AS other FROM t JOIN pairs ON conv_id = chosen_id),
common AS (SELECT chosen_id, coalesce(min(k) FILTER (text <> other) - 1, max(k)) AS n_common FROM turns GROUP BY chosen_id),
sized AS (
  SELECT *, length(role) + 13 AS head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS c, '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) AS r
  FROM turns JOIN common USING (chosen_id)
),
placed AS (
  SELECT *, coalesce(sum(length(c)) OVER w, 0) AS c_at, coalesce(sum(length(r)) OVER w, 0) AS r_at
  FROM sized WINDOW w AS (PARTITION BY chosen_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT chosen_id AS pair_id, chosen_id, any_value(rejected_id) AS rejected_id, CAST(any_value(n_common) AS BIGINT) AS n_common,
       coalesce(string_agg(c, '' ORDER BY k) FILTER (k <= n_common), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY k) FILTER (k > n_common), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY k) FILTER (k > n_common), '') AS rejected,
       coalesce(string_agg((c_at + head) || ':' || (c_at + length(c)), ',' ORDER BY k) FILTER (k > n_common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((r_at + head) || ':' || (r_at + length(r)), ',' ORDER BY k) FILTER (k > n_common AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY chosen_id
"""


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.repeated_lines(table(spark, sf_dir, "documents")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.secret_scan(table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_bpe_encode_decode,
        op3_quality_rules,
        op4_html_extract,
        op5_preference_format,
        op6_minhash_near_dedup,
        op7_line_dedup,
        op8_mix_sources,
        op9_secret_scan,
        op10_quality_classifier,
    )
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op5_preference_format": OP5_SQL}
