"""Checking facts against their sources: rules, judgements, injection rechecks, story status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.numbers import extract_numbers, surface_forms
from newsloom.functions.responses import cache_key, parse_judgement, parse_recheck
from newsloom.functions.scan import THRESHOLD, grey_zone
from newsloom.functions.text import advice_phrase, best_text, extract_tickers, normalize_text, opinion_marker

JUDGE_VERSION, RECHECK_VERSION = "judge_v1", "recheck_v1"
#: Checks in the order in which they run; the last one only flags.
CHECKS = ["no_advice", "quote_exists", "numbers_grounded", "entities_grounded", "opinion_placement"]


def _sources(evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """(fact_id, sources): each fact's quotes and their articles' texts, as they are and normalised."""
    a = articles.select(F.col("id").alias("article_id"), best_text(F.col("clean_text"), F.col("summary_raw"), F.col("title")).alias("text"))
    # A text is normalised once, however many quotes cite it.
    a = a.join(evidence.select("article_id").distinct(), "article_id", "left_semi").withColumn("plain_text", normalize_text(F.col("text")))
    e = evidence.select("fact_id", "article_id", "quote_en", F.col("id").alias("evidence_id"), normalize_text(F.col("quote_en")).alias("plain_quote")).join(a, "article_id", "left")
    one = F.struct("evidence_id", "article_id", "quote_en", "text", "plain_quote", "plain_text")
    return e.groupBy("fact_id").agg(F.sort_array(F.collect_list(one)).alias("sources"))


def _missing_quote(s: Column) -> Column:
    there = F.contains(s["plain_text"], s["plain_quote"]) | F.contains(F.lower(s["plain_text"]), F.lower(s["plain_quote"]))
    article = s["article_id"].cast("string")
    return (
        F.when(s["text"].isNull(), F.concat(F.lit("article not found: "), article)).when(s["plain_quote"] == "", F.concat(F.lit("empty quote: "), article))
        .when(~there, F.concat(F.lit("quote not found: "), article))
    )


def fact_checks(facts: DataFrame, evidence: DataFrame, articles: DataFrame, fixed: bool = False) -> DataFrame:
    """Facts with `failed`, an array with what each check found wrong (null if nothing), in the order of CHECKS."""
    f = facts.join(_sources(evidence, articles).withColumnRenamed("fact_id", "id"), "id", "left")
    empty = F.array().cast("array<struct<evidence_id: bigint, article_id: bigint, quote_en: string, text: string, plain_quote: string, plain_text: string>>")
    f = f.withColumns({"sources": F.coalesce("sources", empty), "numbers": extract_numbers(normalize_text(F.col("text_bg")), fixed)})
    # The forms of a number are written out once, not for each text that they are sought in.
    forms = F.transform("numbers", lambda n: F.struct(n["value"].alias("value"), n["unit"].alias("unit"), F.transform(surface_forms(n["value"], n["unit"]), F.lower).alias("forms")))
    f = f.withColumn("numbers", forms)
    s = F.col("sources")
    first = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(1))
    plain = F.flatten(F.transform(s, lambda x: F.array(F.lower(x["plain_quote"]), F.lower(F.coalesce(x["plain_text"], F.lit(""))))))
    loose = F.filter("numbers", lambda n: ~F.exists(plain, lambda t: F.exists(n["forms"], lambda x: F.contains(t, x))))
    combined = F.upper(F.array_join(F.flatten(F.transform(s, lambda x: F.array(x["quote_en"], F.coalesce(x["text"], F.lit(""))))), " "))
    tickers = F.filter(extract_tickers(F.col("text_bg")), lambda t: ~F.contains(combined, t))
    failed = F.array(
        advice_phrase(F.col("text_bg")), first(F.transform(s, _missing_quote)),
        F.when(F.size(loose) > 0, F.concat(F.try_element_at(loose, F.lit(1))["value"].cast("string"), F.lit(" "), F.try_element_at(loose, F.lit(1))["unit"])),
        F.when(F.size(tickers) > 0, F.array_join(F.array_sort(tickers), ",")), opinion_marker(F.col("text_bg"), F.transform(s, lambda x: x["quote_en"])),
    )
    return f.select(*facts.columns, failed.alias("failed"))


def verify_facts(facts: DataFrame, evidence: DataFrame, articles: DataFrame, as_of: datetime, fixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pending facts after the rule checks, and a log row for each check that ran.

    Checks stop at the first of the first four that fails, and the fact is removed; the last one only
    flags, and leaves a fact pending for a judgement.
    """
    checked = fact_checks(facts.filter("verification_status = 'pending'"), evidence, articles, fixed)
    at = F.coalesce(*[F.when(F.element_at("failed", i).isNotNull(), F.lit(i)) for i in range(1, 5)], F.lit(0))
    checked = checked.withColumn("stop", at)
    status = F.when(F.col("stop") > 0, "removed").when(F.element_at("failed", 5).isNotNull(), "pending").otherwise("verified")
    ran = F.slice("failed", 1, F.when(F.col("stop") > 0, F.col("stop")).otherwise(F.lit(5)))
    log = checked.select("story_id", F.col("id").alias("fact_id"), F.posexplode(ran).alias("i", "found"))
    names = F.array(*[F.lit(c) for c in CHECKS])
    name = F.element_at(names, F.col("i") + 1)
    log = log.select("story_id", "fact_id", name.alias("check"), F.col("found").isNull().alias("passed"), F.coalesce(F.concat(name, F.lit(": "), "found"), F.lit("")).alias("details"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
    done = checked.withColumn("verification_status", status).select(facts.columns)
    return done.unionByName(facts.filter("verification_status <> 'pending'")), log


def _flagged(log: DataFrame) -> DataFrame:
    """Facts that the last check flagged."""
    return log.filter("check = 'opinion_placement' and not passed").select(F.col("fact_id").alias("id")).distinct()


def judgement_requests(facts: DataFrame, log: DataFrame, evidence: DataFrame, version: str = JUDGE_VERSION, model: str = "small") -> DataFrame:
    """(fact_id, cache_key, user_msg): pending facts that a check flagged, with their quotes by evidence id, as JSON."""
    todo = facts.filter("verification_status = 'pending'").join(_flagged(log), "id", "left_semi")
    quotes = evidence.join(todo.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("id", "quote_en"))).alias("q"))
    said = F.coalesce(F.transform("q", lambda x: x["quote_en"]), F.array().cast("array<string>"))
    both = todo.select(F.col("id").alias("fact_id"), "text_bg").join(quotes, "fact_id", "left")
    msg = both.select("fact_id", F.to_json(F.struct("fact_id", F.col("text_bg").alias("fact_text_bg"), said.alias("quotes"))).alias("user_msg"))
    return msg.select("fact_id", cache_key(F.lit(version), F.lit(model), F.col("user_msg")).alias("cache_key"), "user_msg")


def apply_judgements(facts: DataFrame, log: DataFrame, verdicts: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Settle the facts that a check only flagged, by verdicts (fact_id, response_text).

    Supported facts are verified, unsupported ones removed; a missing or invalid verdict leaves a fact
    partially supported. A valid verdict is logged.
    """
    v = verdicts.select(F.col("fact_id").alias("id"), parse_judgement(F.col("response_text"))["value"].alias("v")).dropDuplicates(["id"])
    support = F.when(F.col("v.fact_id") == F.col("id"), F.col("v.support"))
    asked = _flagged(log).join(v, "id", "left").select("id", support.alias("support"), F.lit(True).alias("asked"))
    new = F.when(F.col("support") == "not_supported", "removed").when(F.col("support") == "supported", "verified").otherwise("partially_supported")
    both = facts.join(asked, "id", "left")
    out = both.withColumn("verification_status", F.when(F.col("asked") & (F.col("verification_status") == "pending"), new).otherwise(F.col("verification_status")))
    told = both.filter("support is not null").select(
        "story_id", F.col("id").alias("fact_id"), F.lit("llm_judge").alias("check"), (F.col("support") != "not_supported").alias("passed"),
        F.concat(F.lit("support="), "support").alias("details"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )
    return out.select(facts.columns), told


def _grey_articles(articles: DataFrame, members: DataFrame, min_score: float) -> DataFrame:
    """(article_id, text) of clustered articles in the grey zone that have a text."""
    grey = articles.filter(grey_zone(F.col("status"), F.col("injection_score"), min_score, THRESHOLD))
    text = grey.select(F.col("id").alias("article_id"), best_text(F.col("clean_text"), F.col("summary_raw"), F.col("title")).alias("text"))
    return text.filter(F.trim("text") != "").join(members.select("article_id"), "article_id", "left_semi")


def recheck_requests(articles: DataFrame, members: DataFrame, min_score: float = 0.0, version: str = RECHECK_VERSION, model: str = "small") -> DataFrame:
    """(article_id, cache_key, user_msg): the texts of clustered grey-zone articles, to be judged for injection."""
    msg = _grey_articles(articles, members, min_score)
    return msg.select("article_id", cache_key(F.lit(version), F.lit(model), F.col("text")).alias("cache_key"), F.col("text").alias("user_msg"))


def apply_injection_recheck(articles: DataFrame, members: DataFrame, stories: DataFrame, verdicts: DataFrame, as_of: datetime, min_score: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quarantine clustered grey-zone articles whose verdict (article_id, response_text) says injection.

    Returns articles, a story-level log row for each of their stories, and the clusters to summarise anew.
    """
    v = verdicts.select("article_id", parse_recheck(F.col("response_text"))["value"].alias("v")).filter("v.is_injection").select("article_id").distinct()
    hit = _grey_articles(articles, members, min_score).select("article_id").join(v, "article_id", "left_semi").distinct()
    marked = articles.join(hit.select(F.col("article_id").alias("id"), F.lit(True).alias("hit")), "id", "left")
    out = marked.withColumn("status", F.when(F.col("hit"), "quarantined").otherwise(F.col("status"))).select(articles.columns)
    clusters = members.join(hit, "article_id", "left_semi").select("cluster_id").distinct()
    log = stories.join(clusters, "cluster_id", "left_semi").select(
        F.col("id").alias("story_id"), F.lit(None).cast("long").alias("fact_id"), F.lit("injection_recheck").alias("check"), F.lit(False).alias("passed"),
        F.lit("article quarantined").alias("details"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )
    return out, log, clusters


def story_status(stories: DataFrame, facts: DataFrame) -> DataFrame:
    """Stories with the status that follows from their facts; a story without facts is verified."""
    good = F.count_if(F.col("verification_status").isin("verified", "partially_supported"))
    n = facts.groupBy("story_id").agg(F.count("*").alias("n_facts"), good.alias("n_good")).withColumnRenamed("story_id", "id")
    status = F.when(F.coalesce("n_facts", F.lit(0)) == 0, "verified").when(F.col("n_good") == 0, "unverified").when(F.col("n_good") < F.col("n_facts"), "partial").otherwise("verified")
    return stories.join(n, "id", "left").withColumn("verification_status", status).select(stories.columns)
