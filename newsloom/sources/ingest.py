"""From landed rows to articles: canonical URLs, hashes, clean text, scores, first-writer-wins inserts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.ids import key_id
from newsloom.functions.scan import RULES, THRESHOLD, Rule, article_status, matched_rules, score_of
from newsloom.functions.text import content_hash, sanitize_html
from newsloom.functions.urls import canonical_url
from newsloom.session import ship

STALE_HOURS = 48


def prepared(raw: DataFrame, sources: DataFrame, as_of: datetime, rules: list[Rule] = RULES, threshold: float = THRESHOLD, fetched_at: Column | None = None) -> DataFrame:
    """Raw rows that have a title and a URL, as articles (with `arrival`), fetched at `as_of` or as `fetched_at` says. The scan reads the raw markup."""
    ship(raw.sparkSession)
    ok = raw.filter("coalesce(title, '') <> '' and coalesce(url, '') <> ''")
    known = ok.join(sources.select(F.col("name").alias("source"), F.col("id").alias("source_id")), "source")
    scanned = F.concat("title", F.lit(" "), F.coalesce("summary_raw", F.lit("")))
    rows = known.withColumns({"canonical_url": canonical_url(F.col("url")), "matched_rules": matched_rules(scanned, rules)}).withColumn("injection_score", score_of(F.col("matched_rules"), rules))
    return rows.select(
        key_id(F.lit("article"), F.col("canonical_url")).alias("id"), "source_id", "publisher", "title", "summary_raw", "url", "canonical_url", "published_at", (F.lit(as_of).cast("timestamp_ntz") if fetched_at is None else fetched_at).alias("fetched_at"), "tickers",
        content_hash(F.col("title"), F.col("summary_raw")).alias("content_hash"), sanitize_html(F.col("summary_raw")).alias("clean_text"), "injection_score", "matched_rules",
        article_status(F.col("injection_score"), threshold).alias("status"), "sec_form_type", "sec_items", "event_type_hint", "arrival",
    )


def upsert_articles(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of `batch` (with `arrival`) to append: the first of each canonical URL that `target` doesn't hold."""
    turn = F.row_number().over(Window.partitionBy("canonical_url").orderBy("arrival"))
    return batch.withColumn("turn", turn).filter("turn = 1").drop("turn", "arrival").join(target.select("canonical_url"), "canonical_url", "left_anti").select(*[c for c in batch.columns if c != "arrival"])


def fetch_run_ledger(raw: DataFrame, batch: DataFrame, new: DataFrame, sources: DataFrame, as_of: datetime, errors: DataFrame | None = None) -> DataFrame:
    """A run's row for each source: items seen (all rows), items new, newest item (of valid rows, known ones too).

    `errors` (source, error) are sources whose fetch failed; their messages are cut to 1000 characters.
    """
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    seen = raw.groupBy("source").agg(F.count("*").alias("items_seen"))
    newest = batch.groupBy("source_id").agg(F.max("published_at").alias("newest_item_at"), F.max_by("title", F.struct("published_at", -F.col("arrival"))).alias("newest_title"))
    fresh = new.groupBy("source_id").agg(F.count("*").alias("items_new"))
    failed = errors.select("source", F.substring("error", 1, 1000).alias("error")) if errors is not None else None
    rows = s.join(seen, "source", "left").join(newest, "source_id", "left").join(fresh, "source_id", "left")
    rows = rows.join(failed, "source", "left") if failed is not None else rows.withColumn("error", F.lit(None).cast("string"))
    stale = F.col("newest_item_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval '{STALE_HOURS}' hour")
    status = F.when(F.col("error").isNotNull(), "error").when(stale, "stale").otherwise("ok")
    zero = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c)
    at = F.lit(as_of).cast("timestamp_ntz")
    return rows.select(key_id(F.lit("run"), F.col("source_id"), F.lit(str(as_of))).alias("id"), "source_id", at.alias("started_at"), at.alias("finished_at"), status.alias("status"), zero("items_seen"), zero("items_new"), "error", "newest_item_at", "newest_title")


def ingest(raw: DataFrame, articles: DataFrame, sources: DataFrame, as_of: datetime, rules: list[Rule] = RULES, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles to append, fetch runs). A failed source's error doesn't stop the others."""
    batch = prepared(raw, sources, as_of, rules)
    new = upsert_articles(batch, articles)
    return new, fetch_run_ledger(raw, batch, new, sources, as_of, errors)
