"""The driver's tables as the model's tables, in Spark SQL and, for comparison, in DuckDB SQL.

Both sides are written out for each view; ids come from keys. Times of reference are fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import table

ARTICLES_AS_OF = datetime(2024, 1, 5)
CALLS_AS_OF = datetime(2024, 1, 15, 12)
ORDERS_AS_OF = datetime(2001, 8, 2)

_SOURCE_ID = "cast(substr(source, 4) as int)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("source").distinct().withColumn("id", F.expr(_SOURCE_ID).cast("long"))
    kind = F.when(F.col("id") % 7 == 0, "primary").when(F.col("id") % 2 == 1, "api").otherwise("rss")
    return s.select("id", F.col("source").alias("name"), kind.alias("kind"), (F.col("id") % 7 == 0).alias("is_official"), (F.col("id") % 9 != 8).alias("enabled"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    i = F.col("doc_id")
    title = F.substring("text", 1, 60)
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=(i % 96).cast("int"))
    return t.select(
        i.alias("id"), F.expr(_SOURCE_ID).cast("long").alias("source_id"), F.when(i % 13 != 0, F.col("source")).alias("publisher"), title.alias("title"), F.col("text").alias("summary_raw"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/a/"), i.cast("string"), F.lit("/?utm_source=x#t")).alias("url"), at.alias("published_at"), at.alias("fetched_at"),
        F.when(i % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.upper("lang"))).alias("tickers"), F.lit(None).cast("string").alias("clean_text"),
        F.when(i % 17 == 0, "quarantined").otherwise("active").alias("status"), F.sha2(F.concat(title, F.lit("|"), "text"), 256).alias("content_hash"),
        F.when(i % 17 == 0, 0.75).when(i % 11 == 0, 0.25).otherwise(0.0).alias("injection_score"), F.when(i % 17 == 0, F.array(F.lit("role_override"), F.lit("role_markers"))).otherwise(F.array().cast("array<string>")).alias("matched_rules"),
    )


def no_members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cluster_id long, article_id long, match_method string, similarity double, needs_llm_check boolean")


def llm_calls(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "cache_hit").when(F.col("event_type") == "error", "rejected").otherwise("ok")
    e = table(spark, d, "events").withColumn("status", status)
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("purpose"), F.col("ts").alias("created_at"), "status", F.when(F.col("status") == "cache_hit", 0.0).otherwise(F.col("value") / 1000).alias("cost_usd"))


def fetch_runs(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "stale").otherwise("error")
    return table(spark, d, "orders").select(
        k.alias("id"), (c % 20).alias("source_id"), F.col("o_orderdate").alias("started_at"), F.when(k % 11 != 0, F.col("o_orderdate") + F.expr("interval 30 seconds")).alias("finished_at"),
        status.alias("status"), (c % 50).alias("items_seen"), (c % 7).alias("items_new"),
    )


def _ticker():
    return F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string"))


def story_clusters(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    subject = F.when(p == "1-URGENT", F.lit(None).cast("boolean")).otherwise(p != "5-LOW")
    event = F.when(k % 4 == 0, "earnings").when(k % 4 == 1, "legal").when(k % 4 == 2, "product_launch")
    return table(spark, d, "orders").select(
        k.alias("id"), _ticker().alias("primary_ticker"), F.col("o_orderdate").alias("first_seen_at"), (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 96).cast("int"))).alias("last_seen_at"),
        (1 + k % 5).alias("article_count"), (1 + k % 3).alias("publisher_count"), event.alias("event_type"), (F.col("o_orderstatus") != "P").alias("visible"), subject.alias("is_main_subject"),
        (k % 5 == 0).alias("is_opinion"), F.lit(False).alias("has_primary_source"), F.lit(None).cast("string").alias("sec_filing_url"), F.when(k % 6 != 0, "small").alias("classification_model"),
    )


def stories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "verified", "partial", "unverified")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").filter("o_orderpriority <> '4-NOT SPECIFIED'").select(
        k.alias("id"), k.alias("cluster_id"), F.concat(F.lit("Story "), k.cast("string")).alias("title_bg"), F.concat(F.lit("Summary "), k.cast("string")).alias("summary_bg"), F.array(_ticker()).alias("tickers"),
        F.lit(None).cast("string").alias("event_type"), (k % 5 == 0).alias("is_opinion"), status.alias("verification_status"), F.lit("large").alias("model_version"), F.lit("summarize_v1").alias("prompt_version"),
        (F.col("o_orderdate") + F.expr("interval 48 hours")).alias("created_at"),
    )


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("article_id")).agg(F.max(F.col("l_linestatus") == "O").alias("needs_llm_check"))
    return rows.select("cluster_id", "article_id", F.lit("minhash").alias("match_method"), F.lit(1.0).alias("similarity"), "needs_llm_check")


def story_facts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "partially_supported").otherwise("removed")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(status).alias("verification_status"))
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return rows.select(i.alias("id"), F.col("l_orderkey").alias("story_id"), (F.col("l_linenumber") - 1).alias("fact_order"), F.concat(F.lit("Fact "), i.cast("string")).alias("text_bg"), "verification_status")


def fact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each fact cites the article of its smallest part."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("article_id"))
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return rows.select((i * 2).alias("id"), i.alias("fact_id"), "article_id", F.concat(F.lit("Quote "), i.cast("string")).alias("quote_en"))


def verification_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("story_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_id"), F.concat(F.lit("check_"), F.col("l_linenumber").cast("string")).alias("check"),
        (F.col("l_returnflag") != "R").alias("passed"), F.col("l_partkey").cast("string").alias("details"), F.col("l_shipdate").alias("created_at"),
    )


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Orders partly shipped as articles of a primary source, their hints by priority."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    hint = F.when(p == "1-URGENT", "earnings").when(p == "2-HIGH", "regulatory").when(p == "5-LOW", "merger_acquisition").otherwise("other")
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        (k + 1_000_000_000).alias("id"), F.lit(0).cast("long").alias("source_id"), F.concat(F.lit("https://filings.example.com/"), k.cast("string")).alias("url"), F.col("o_orderdate").alias("published_at"),
        F.array(_ticker()).alias("tickers"), hint.alias("event_type_hint"), F.lit("active").alias("status"),
    )


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (sources, articles, llm_calls, fetch_runs, story_clusters, stories, cluster_members, story_facts, fact_evidence, verification_log, filings)
}

_DUCK_TICKER = "'T' || (o_custkey % 40)::varchar"
SQL_VIEWS = {
    "sources": "select distinct cast(substr(source, 4) as bigint) as id, source as name, case when cast(substr(source, 4) as int) % 7 = 0 then 'primary' when cast(substr(source, 4) as int) % 2 = 1 then 'api' else 'rss' end as kind, cast(substr(source, 4) as int) % 9 <> 8 as enabled from documents",
    "articles": "select doc_id as id, cast(substr(source, 4) as bigint) as source_id, case when doc_id % 13 <> 0 then source end as publisher, substr(text, 1, 60) as title, text as summary_raw, 'https://www.' || source || '.example.com/a/' || doc_id || '/?utm_source=x#t' as url, timestamp '2024-01-01' + to_hours(doc_id % 96) as published_at, case when doc_id % 10 = 0 then []::varchar[] else [upper(lang)] end as tickers, case when doc_id % 17 = 0 then 'quarantined' else 'active' end as status, sha256(substr(text, 1, 60) || '|' || text) as content_hash, case when doc_id % 17 = 0 then 0.75 when doc_id % 11 = 0 then 0.25 else 0.0 end::double as injection_score from documents",
    "calls": "select event_id as id, event_type as purpose, ts as created_at, case event_type when 'view' then 'cache_hit' when 'error' then 'rejected' else 'ok' end as status, case event_type when 'view' then 0.0 else value / 1000 end as cost_usd from events",
    "runs": "select o_orderkey as id, o_custkey % 20 as source_id, o_orderdate as started_at, case when o_orderkey % 11 <> 0 then o_orderdate + to_seconds(30) end as finished_at, case o_orderstatus when 'F' then 'ok' when 'O' then 'stale' else 'error' end as status, o_custkey % 50 as items_seen, o_custkey % 7 as items_new from orders",
    "clusters": f"select o_orderkey as id, {_DUCK_TICKER} as primary_ticker, o_orderdate as first_seen_at, o_orderdate + to_hours(o_orderkey % 96) as last_seen_at, 1 + o_orderkey % 5 as article_count, 1 + o_orderkey % 3 as publisher_count, case o_orderkey % 4 when 0 then 'earnings' when 1 then 'legal' when 2 then 'product_launch' end as event_type, o_orderstatus <> 'P' as visible, case when o_orderpriority <> '1-URGENT' then o_orderpriority <> '5-LOW' end as is_main_subject, o_orderkey % 5 = 0 as is_opinion, case when o_orderkey % 6 <> 0 then 'small' end as classification_model from orders",
    "stories": f"select o_orderkey as id, o_orderkey as cluster_id, 'Story ' || o_orderkey as title_bg, 'Summary ' || o_orderkey as summary_bg, {_DUCK_TICKER} as ticker, o_orderkey % 5 = 0 as is_opinion, (['pending', 'verified', 'partial', 'unverified'])[o_orderkey % 4 + 1] as verification_status, o_orderdate + to_hours(48) as created_at from orders where o_orderpriority <> '4-NOT SPECIFIED'",
    "members": "select l_orderkey as cluster_id, l_partkey as article_id, bool_or(l_linestatus = 'O') as needs_llm_check from lineitem group by all",
    "facts": "select l_orderkey * 8 + l_linenumber as id, l_orderkey as story_id, l_linenumber - 1 as fact_order, 'Fact ' || (l_orderkey * 8 + l_linenumber) as text_bg, min(case l_returnflag when 'A' then 'verified' when 'N' then 'partially_supported' else 'removed' end) as verification_status from lineitem group by l_orderkey, l_linenumber",
    "evidence": "select (l_orderkey * 8 + l_linenumber) * 2 as id, l_orderkey * 8 + l_linenumber as fact_id, min(l_partkey) as article_id, 'Quote ' || (l_orderkey * 8 + l_linenumber) as quote_en from lineitem group by l_orderkey, l_linenumber",
    "log": "select l_orderkey as story_id, l_orderkey * 8 + l_linenumber as fact_id, 'check_' || l_linenumber as \"check\", l_returnflag <> 'R' as passed, l_partkey::varchar as details, l_shipdate as created_at from lineitem",
    "filings": f"select o_orderkey + 1000000000 as id, {_DUCK_TICKER} as ticker, o_orderdate as published_at, case o_orderpriority when '1-URGENT' then 'earnings' when '2-HIGH' then 'regulatory' when '5-LOW' then 'merger_acquisition' else 'other' end as hint, 'https://filings.example.com/' || o_orderkey as url from orders where o_orderstatus = 'P'",
}


def with_views(names: str, query: str) -> str:
    """DuckDB SQL over the named views, written as `query` or as further `name as (...)` clauses and a query."""
    heads = ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in names.split())
    return f"with {heads}{query}" if query.startswith(",") else f"with {heads} {query}"
