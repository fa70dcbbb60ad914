"""The queries opN_<name> over whole tables: thin, with production parameters, each through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktide.llm import bpe, fuzzy_lines, ngram, pii, postings, quality, simhash, suffix, token_files, units
from talktide.llm.common import table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.counts(table(spark, sf_dir, "documents"), ranks_path(), pre_token_pattern())


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"), order=ngram.ORDER)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_lines.dedup(table(spark, sf_dir, "documents"), bits=None)
    return found.select("doc_id", F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_terms")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), ranks_path(), pre_token_pattern())
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.dedup(table(spark, sf_dir, "documents"), "sentence", least_run=units.LEAST_RUN)
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", "spans", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS b, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), cuts AS (
  SELECT *, string_split(regexp_replace(line, '([.!?][ \t\x0B\f\r]+)', '\1' || chr(1), 'g'), chr(1)) AS c,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_at
  FROM lines
), pieces AS (
  SELECT doc_id, b, line, line_at, len(c) AS n, unnest(range(len(c))) AS i, unnest(c) AS whole FROM cuts
), placed AS (
  SELECT *, CASE WHEN i + 1 < n THEN regexp_replace(whole, '[ \t\x0B\f\r]+$', '') ELSE whole END AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY b, i) - 1 AS unit_no,
    line_at + coalesce(sum(length(whole)) OVER (PARTITION BY doc_id, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
  FROM pieces
), normal AS (
  SELECT *, trim(regexp_replace(lower(unit), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS plain FROM placed
), ranked AS (
  SELECT *, plain <> '' AS real, plain <> '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, unit_no) > 1 AS again,
    CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS words
  FROM normal
), parted AS (
  SELECT *, sum((real AND NOT again)::INT) OVER (PARTITION BY doc_id ORDER BY unit_no ROWS UNBOUNDED PRECEDING) AS island FROM ranked
), judged AS (
  SELECT *, again AND coalesce(sum(words) FILTER (again) OVER (PARTITION BY doc_id, island), 0) >= 25 AS gone FROM parted
), ended AS (
  SELECT *, max(unit_no) FILTER (NOT gone) OVER (PARTITION BY doc_id, b) AS final FROM judged
), blocks AS (
  SELECT doc_id, b, CASE WHEN NOT bool_or(gone) THEN any_value(line)
      WHEN bool_or(real AND NOT gone) THEN string_agg(CASE WHEN unit_no = final THEN unit ELSE whole END, '' ORDER BY unit_no) FILTER (NOT gone) END AS part,
    count(*) FILTER (real) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(unit)) FILTER (gone), 0) AS chars,
    string_agg(s || ':' || (s + length(unit)), ',' ORDER BY unit_no) FILTER (gone) AS spans
  FROM ended GROUP BY doc_id, b
)
SELECT doc_id, sum(n_units)::BIGINT AS n_units, sum(n_removed)::BIGINT AS n_removed, sum(chars)::BIGINT AS removed_chars,
  coalesce(string_agg(spans, ',' ORDER BY b), '') AS spans, sha256(coalesce(string_agg(part, chr(10) ORDER BY b), '')) AS kept_sha256
FROM blocks GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_ngram_trie, op3_decontamination, op4_fuzzy_lines, op5_simhash, op6_quality_rules, op7_disclosure, op8_byte_bpe, op9_unit_dedup, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op9_unit_dedup": OP9_SQL}
