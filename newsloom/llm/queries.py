"""The queries over the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import contract_sql, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, mixing, nearest, quality_rules, ranked_search, resampling, secrets, substring_dedup, warc
from newsloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(table(spark, sf_dir, "documents"), width=50)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"), min_points=10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_ids(table(spark, sf_dir, "documents"), size=5, percent=75)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secret scan's columns that SQL can state."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram base of LM scoring, by the same counts and joins."""
    base = lm_scoring.base_scored(table(spark, sf_dir, "documents"))
    return base.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules' columns that SQL can state."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def language_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the language identifier doesn't learn from."""
    return op5_language_id(spark, sf_dir).select("doc_id", "held_out")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_mixing, op3_decontamination, op4_line_dedup, op5_language_id,
        op6_jaccard_join, op7_secret_scan, op8_warc_revisits, op9_lm_scoring, op10_quality_rules,
        op11_nearest, op12_resampling, op13_ranked_search,
        secret_base_spans, lm_base_scores, quality_base_counts, language_held_out,
    )
}

#: SQL has the same words, lines and hashes; DuckDB's trim set is written out.
OP4_SQL = r"""
with l as (
  select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents
), s as (
  select rid, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from l
), k as (
  select rid, doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from s
), h as (
  select key, min(doc_id) as keeper, count(distinct doc_id) as docs from k where length(key) >= 10 group by key
), j as (
  select k.rid, k.doc_id, pos, line, h.docs is not null and h.docs >= 2 and k.doc_id <> h.keeper as gone from k left join h on k.key = h.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by rid, doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": contract_sql.SUBSTRING_DEDUP,
    "op2_mixing": mixing.SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_jaccard_join": contract_sql.JACCARD_JOIN,
    "op8_warc_revisits": warc.SQL,
    "op11_nearest": contract_sql.NEAREST,
    "op12_resampling": contract_sql.RESAMPLING,
    "op13_ranked_search": contract_sql.RANKED_SEARCH,
    "secret_base_spans": contract_sql.SECRET_BASE,
    "lm_base_scores": contract_sql.LM_BASE,
    "quality_base_counts": contract_sql.QUALITY_BASE,
    "language_held_out": contract_sql.HELD_OUT,
}
