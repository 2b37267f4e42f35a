"""Read models: feeds, details, lists, funnel, quarantine, digest."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.clusters import since
from newsloom.operators.ordered import numbered_along
from newsloom.session import staged

FAILED_CHECKS = 200


def ticker_in(tickers: Column, ticker: str) -> Column:
    """Whether a ticker is listed, in any letter case; no part of a longer one counts."""
    return F.coalesce(F.exists(tickers, lambda x: F.upper(x) == ticker.upper()), F.lit(False))


def in_feed() -> Column:
    """Visible, and not known to be about something else: an unknown subject passes."""
    return F.coalesce(F.col("visible"), F.lit(False)) & F.coalesce(F.col("is_main_subject"), F.lit(True))


def relevant() -> Column:
    """Visible, and known to be about its subject."""
    return F.coalesce(F.col("visible"), F.lit(False)) & F.coalesce(F.col("is_main_subject"), F.lit(False))


def _links(members: DataFrame, articles: DataFrame) -> DataFrame:
    """(cluster_id, links): active articles of each cluster."""
    a = articles.filter("status = 'active'").select(F.col("id").alias("article_id"), "title", "url", "publisher", "published_at")
    inside = members.select("cluster_id", "article_id").join(a, "article_id")
    return inside.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("article_id", "title", "url", "publisher", "published_at"))).alias("links"))


CLUSTER_COLUMNS = ["primary_ticker", "publisher_count", "article_count", "first_seen_at", "last_seen_at", "has_primary_source", "sec_filing_url", "visible", "is_main_subject"]


def story_feed(stories: DataFrame, clusters: DataFrame, members: DataFrame, articles: DataFrame, as_of: datetime, hours: float = 24, ticker: str | None = None, opinions: bool = False, hidden: bool = False) -> DataFrame:
    """Stories of clusters last seen in the window, newest first, with links to their active articles."""
    if not 1 <= hours <= 168:
        raise ValueError("hours must be from 1 to 168")
    c = clusters.filter(F.col("last_seen_at") >= since(as_of, hours))
    if not hidden:
        c = c.filter(in_feed())
    s = stories if opinions else stories.filter(~F.col("is_opinion"))
    both = s.join(c.select(F.col("id").alias("cluster_id"), *[x for x in CLUSTER_COLUMNS if x in clusters.columns]), "cluster_id")
    if ticker:
        both = both.filter(F.coalesce(F.col("primary_ticker") == ticker.upper(), F.lit(False)) | ticker_in(F.col("tickers"), ticker))
    # Only members of the feed's clusters are linked, not those of all clusters.
    shown = members.join(both.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return both.join(_links(shown, articles), "cluster_id", "left").orderBy(F.desc("last_seen_at"), "id")


def story_display(feed: DataFrame) -> DataFrame:
    """What a card shows: a pending story no generated text, and at most three links."""
    shown = lambda c: F.when(F.col("verification_status") != "pending", F.col(c)).alias(c)
    return feed.select(*[shown(c) if c in ("title_bg", "summary_bg") else F.when(F.col("verification_status") == "pending", F.slice("links", 1, 3)).otherwise(F.col("links")).alias(c) if c == "links" else F.col(c) for c in feed.columns])


def story_detail(feed: DataFrame, facts: DataFrame, evidence: DataFrame, articles: DataFrame, narrow: bool = False) -> DataFrame:
    """Feed rows with their facts in order, removed ones too, each with its evidence.

    `narrow`: only what the feed's stories hold is gathered, which pays for a feed of few stories.
    """
    if narrow:
        facts = staged(facts.join(feed.select(F.col("id").alias("story_id")).distinct(), "story_id", "left_semi"), "facts")
        evidence = evidence.join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    a = articles.select(F.col("id").alias("article_id"), "publisher", "published_at", "url")
    e = evidence.join(a, "article_id").groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("id", "article_id", "quote_en", "publisher", "published_at", "url"))).alias("evidence"))
    f = facts.withColumnRenamed("id", "fact_id").join(e, "fact_id", "left")
    per = f.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("fact_order", "fact_id", "text_bg", "verification_status", "evidence"))).alias("facts"))
    return feed.join(per, feed["id"] == per["story_id"], "left").drop("story_id")


def article_list(articles: DataFrame, as_of: datetime, hours: float = 24, ticker: str | None = None) -> DataFrame:
    """Articles of the window in any status, newest first."""
    a = articles.filter(F.col("published_at") >= since(as_of, hours))
    return (a.filter(ticker_in(F.col("tickers"), ticker)) if ticker else a).orderBy(F.desc("published_at"), "id")


def funnel(articles: DataFrame, clusters: DataFrame, as_of: datetime, hours: float = 24, ticker: str | None = None) -> DataFrame:
    """One row: articles, clusters and relevant clusters of the window; articles in any status."""
    a = articles.filter(F.col("published_at") >= since(as_of, hours))
    c = clusters.filter(F.col("last_seen_at") >= since(as_of, hours))
    if ticker:
        a, c = a.filter(ticker_in(F.col("tickers"), ticker)), c.filter(F.col("primary_ticker") == ticker.upper())
    return a.agg(F.count("*").alias("articles")).crossJoin(c.agg(F.count("*").alias("clusters"), F.count_if(relevant()).alias("relevant")))  # one row each


def quarantine_list(articles: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    q = articles.filter("status = 'quarantined'").join(s, "source_id")
    return q.select("id", "title", "url", "publisher", "published_at", F.coalesce("injection_score", F.lit(0.0)).alias("injection_score"), "matched_rules", "source_name").orderBy(F.desc("published_at"), "id")


def apply_review(articles: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles after decisions (article_id, decision), and rejected decisions (article_id, decision, problem).

    `release` makes a quarantined article active; `confirm` changes nothing.
    """
    d = decisions.select(F.col("article_id").alias("id"), "decision")
    known = d.join(articles.select("id", "status"), "id", "left")
    problem = F.when(F.col("status").isNull(), "unknown article").when((F.col("decision") == "release") & (F.col("status") != "quarantined"), "not quarantined").when(~F.col("decision").isin("release", "confirm"), "unknown decision")
    freed = d.filter("decision = 'release'").select("id").distinct().withColumn("freed", F.lit(True))
    out = articles.join(freed, "id", "left").withColumn("status", F.when(F.col("freed") & (F.col("status") == "quarantined"), "active").otherwise(F.col("status")))
    return out.select(articles.columns), known.withColumn("problem", problem).filter("problem is not null").select(F.col("id").alias("article_id"), "decision", "problem")


def failed_checks(log: DataFrame, stories: DataFrame, facts: DataFrame, n: int = FAILED_CHECKS) -> DataFrame:
    """The last n failed checks with their story's title and fact's text."""
    keys = ["story_id", "fact_id", "check"]
    last = log.filter("not passed").join(stories.select(F.col("id").alias("story_id"), F.col("title_bg").alias("story_title")), "story_id").orderBy(F.desc("created_at"), *keys).limit(n)
    return last.join(facts.select(F.col("id").alias("fact_id"), F.col("text_bg").alias("fact_text")), "fact_id", "left").orderBy(F.desc("created_at"), *keys)


def facts_report(stories: DataFrame, clusters: DataFrame, facts: DataFrame, log: DataFrame, ticker: str) -> DataFrame:
    """Facts of a ticker's stories, with the checks that failed on each."""
    mine = clusters.filter(F.col("primary_ticker") == ticker.upper()).select(F.col("id").alias("cluster_id"))
    s = stories.join(mine, "cluster_id", "left_semi").select(F.col("id").alias("story_id"), "title_bg", F.col("verification_status").alias("story_status"), "created_at")
    bad = log.filter("not passed and fact_id is not null").groupBy("story_id", "fact_id").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "check", "details"))).alias("failed"))
    f = facts.withColumnRenamed("id", "fact_id").join(s, "story_id")
    return f.join(bad, ["story_id", "fact_id"], "left").select("story_id", "title_bg", "story_status", "created_at", "fact_id", "fact_order", "text_bg", "verification_status", "failed").orderBy(F.desc("created_at"), "story_id", "fact_order", "fact_id")


def export_digest(stories: DataFrame, clusters: DataFrame, facts: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame, day: date) -> DataFrame:
    """(story_id, position, text): the day's checked stories as Markdown sections, newest first."""
    start = datetime(day.year, day.month, day.day)
    told = stories.filter((F.col("created_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(start + timedelta(days=1)).cast("timestamp_ntz")) & F.col("verification_status").isin("verified", "partial"))
    c = clusters.select(F.col("id").alias("cluster_id"), "primary_ticker", "article_count")
    lines = facts.filter("verification_status <> 'removed'").groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("fact_order", "id", F.concat(F.lit("- "), "text_bg").alias("line")))).alias("f"))
    s = sources.select(F.col("id").alias("source_id"), "name")
    a = articles.join(s, "source_id", "left").select(F.col("id").alias("article_id"), F.concat(F.lit("  - ["), F.coalesce("name", "publisher", F.lit("—")), F.lit("]("), "url", F.lit(")")).alias("line"))
    seen = members.join(told.select("cluster_id"), "cluster_id", "left_semi").join(a, "article_id").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("article_id", "line"))).alias("a"))
    both = told.join(c, "cluster_id").join(lines, told["id"] == lines["story_id"], "left").drop("story_id").join(seen, "cluster_id", "left")
    part = lambda title, col: F.when(F.size(F.coalesce(col, F.array())) > 0, F.concat(F.lit(f"**{title}**\n"), F.array_join(F.transform(col, lambda x: x["line"]), "\n"), F.lit("\n")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("## "), "title_bg", F.lit("  ("), F.coalesce("primary_ticker", F.lit("—")), F.lit(")\n")),
        F.concat(F.lit("**Type:** "), F.coalesce("event_type", F.lit("—")), F.lit(" | **Status:** "), "verification_status", F.lit(" | **Articles:** "), F.col("article_count").cast("string"), F.lit("\n")),
        F.concat("summary_bg", F.lit("\n")), part("Facts:", F.col("f")), part("Sources:", F.col("a")), F.lit("---\n"),
    )
    return both.select(F.col("id").alias("story_id"), "created_at", text.alias("text"))


def digest_lines(digest: DataFrame, day: date) -> DataFrame:
    """(day, place, value): the document's lines in order: a title, then the stories, newest first; `place` rises, with gaps."""
    told = numbered_along(digest.select("created_at", "story_id", "text"), [F.col("created_at").desc(), F.col("story_id")], "story")
    lines = told.select((F.col("story") * F.lit(1 << 32)).alias("story"), F.posexplode(F.split("text", "\n")).alias("pos", "value")).select((F.col("story") + F.col("pos")).alias("place"), "value")
    spark = digest.sparkSession
    head = spark.createDataFrame([(0, f"# Digest — {day.isoformat()}"), (1, "")], "place long, value string")
    return head.unionByName(lines).select(F.lit(day).alias("day"), "place", "value")


def write_digest(digest: DataFrame, day: date, path: str, files: int = 1) -> None:
    """The day's document as text under path/day=...: `files` files, by ranges of lines, whose names sort in order.

    Read in the order of names, they are the document. Written again, they replace what this day had, and no other day's.
    """
    lines = digest_lines(digest, day).repartitionByRange(files, "place").sortWithinPartitions("place")
    # Written to the day's own folder: partitionBy would sort the lines once more, by day alone, and a sort that spills mixes equal keys.
    lines.select("value").write.mode("overwrite").text(f"{path}/day={day.isoformat()}")


def digest_text(digest: DataFrame, day: date) -> DataFrame:
    """One row, the whole document, for a day of few stories; `write_digest` takes any."""
    body = F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("created_at", (-F.col("story_id")).alias("k"), "text")))), lambda x: x["text"]), "\n")
    return digest.agg(F.concat(F.lit(f"# Digest — {day.isoformat()}\n\n"), body).alias("value"))
