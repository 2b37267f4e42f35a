"""Source health, alarms, spending, estimates and retention."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budgets:
    daily: float = 1.0
    monthly: float = 10.0


#: Dollars for a token, by price tier and direction.
PRICES = {"small": (1.0e-6, 5.0e-6), "large": (3.0e-6, 15.0e-6)}
#: Tokens in and out, by step, that a cluster takes.
STEP_TOKENS = [("small", 600, 180), ("large", 1200, 500), ("large", 400, 120)]
COST_PER_CLUSTER = sum(n_in * PRICES[tier][0] + n_out * PRICES[tier][1] for tier, n_in, n_out in STEP_TOKENS)


def moment(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def same_day(c: str, at: datetime) -> Column:
    return F.col(c).cast("date") == F.lit(at.date())


def same_month(c: str, at: datetime) -> Column:
    return F.trunc(F.col(c).cast("date"), "MM") == F.lit(at.date().replace(day=1))


def _latest(runs: DataFrame, by: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col(by).desc_nulls_last(), F.desc("id")))
    return runs.withColumn("turn", turn).filter("turn = 1").drop("turn")


def latest_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """The last run of each enabled source; `never_run` for one without."""
    s = sources.filter("enabled").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "kind")
    both = s.join(_latest(runs, "started_at").withColumnRenamed("id", "run_id"), "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("source_name", "kind", "run_id", "started_at", "finished_at", F.coalesce("status", F.lit("never_run")).alias("status"), zero("items_seen"), zero("items_new"))


def source_health(sources: DataFrame, runs: DataFrame, as_of: datetime, stale_hours: float = 48) -> DataFrame:
    """Enabled sources by their last ok run: never_fetched, stale (more than stale_hours ago) or ok."""
    s = sources.filter("enabled").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "kind")
    both = s.join(_latest(runs.filter("status = 'ok'"), "finished_at").select("source_id", F.coalesce("finished_at", "started_at").alias("last_fetch_at")), "source_id", "left")
    hours = F.expr("timestampdiff(SECOND, last_fetch_at, as_of)") / 3600.0
    both = both.withColumn("as_of", moment(as_of)).withColumn("hours", hours)
    status = F.when(F.col("last_fetch_at").isNull(), "never_fetched").when(F.col("hours") > stale_hours, "stale").otherwise("ok")
    return both.select("source_name", "kind", "last_fetch_at", F.round("hours", 1).alias("stale_hours"), status.alias("status"))


def rejected_share(log: DataFrame, as_of: datetime) -> DataFrame:
    """One row: per cent of today's checks that failed; 0 if there were none."""
    return log.filter(same_day("created_at", as_of)).agg(F.coalesce(100 * F.avg(F.when(~F.col("passed"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("rejected_pct"))


def spent(calls: DataFrame, as_of: datetime) -> DataFrame:
    """One row: spent today and this month."""
    zero = F.lit(0.0)
    month = calls.filter(same_month("created_at", as_of))
    return month.agg(F.coalesce(F.sum(F.when(same_day("created_at", as_of), F.col("cost_usd"))), zero).alias("today"), F.coalesce(F.sum("cost_usd"), zero).alias("month"))


def budget_use(calls: DataFrame, budgets: Budgets, as_of: datetime) -> DataFrame:
    """One row: per cent of the daily and the monthly budget in use; 0 without a budget."""
    share = lambda c, b: F.round(100 * F.col(c) / b, 1) if b > 0 else F.lit(0.0)
    return spent(calls, as_of).select(share("today", budgets.daily).alias("daily_pct"), share("month", budgets.monthly).alias("monthly_pct"))


def alarms(health: DataFrame, log: DataFrame, calls: DataFrame, budgets: Budgets, as_of: datetime, rejected_alarm: float = 30) -> DataFrame:
    """(type, source, value): stale sources, too many rejected checks, and a monthly budget near or past its end."""
    stale = health.filter("status <> 'ok'").select(F.lit("stale_source").alias("type"), F.col("source_name").alias("source"), F.col("stale_hours").alias("value"))
    no = F.lit(None).cast("string").alias("source")
    rejected = rejected_share(log, as_of).filter(F.col("rejected_pct") > rejected_alarm).select(F.lit("high_rejection").alias("type"), no, F.round("rejected_pct", 0).alias("value"))
    month = spent(calls, as_of).select((100 * F.col("month") / budgets.monthly if budgets.monthly > 0 else F.lit(0.0)).alias("p"))
    money = month.filter("p >= 80").select(F.when(F.col("p") >= 100, "budget_exhausted").otherwise("budget_warning").alias("type"), no, F.round("p", 0).alias("value"))
    return stale.unionByName(rejected).unionByName(money)


def cost_summary(calls: DataFrame, budgets: Budgets, as_of: datetime) -> DataFrame:
    """One row: spent and left of both budgets."""
    return spent(calls, as_of).select(
        F.round("today", 6).alias("today_usd"), F.round("month", 6).alias("month_usd"),
        F.round(F.greatest(F.lit(0.0), budgets.daily - F.col("today")), 6).alias("today_left_usd"), F.round(F.greatest(F.lit(0.0), budgets.monthly - F.col("month")), 6).alias("month_left_usd"),
    )


def cost_by_purpose(calls: DataFrame, as_of: datetime) -> DataFrame:
    return calls.filter(same_month("created_at", as_of)).groupBy("purpose").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def cost_by_day(calls: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Calls, cache hits and cost of each day since `days` days ago, newest day first."""
    day = F.col("created_at").cast("date").alias("day")
    recent = calls.filter(F.col("created_at") >= moment(as_of) - F.expr(f"interval '{days}' day"))
    out = recent.groupBy(day).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "cache_hit").alias("cache_hits"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))
    return out.orderBy(F.desc("day"))


def work_estimate(clusters: DataFrame, stories: DataFrame, threshold: int = 5, per_cluster: float = COST_PER_CLUSTER) -> DataFrame:
    """One row: visible clusters without a story, with a stale one, their cost, and whether to warn."""
    s = stories.groupBy("cluster_id").agg(F.min("created_at").alias("told_at")).withColumnRenamed("cluster_id", "id")
    both = clusters.filter("visible").join(s, "id", "left")
    n = both.agg(F.count_if(F.col("told_at").isNull()).alias("new_clusters"), F.count_if(F.col("told_at") < F.col("last_seen_at")).alias("changed_clusters"))
    total = F.col("new_clusters") + F.col("changed_clusters")
    return n.select("new_clusters", "changed_clusters", total.alias("total_clusters"), F.round(total * per_cluster, 4).alias("estimated_cost_usd"), (total > threshold).alias("show_warning"))


def retention(stories: DataFrame, facts: DataFrame, evidence: DataFrame, calls: DataFrame, articles: DataFrame, members: DataFrame, as_of: datetime, article_days: int = 90, story_days: int = 365) -> dict[str, DataFrame]:
    """The ids that retention removes, by table.

    Stories and calls older than story_days; facts and evidence of these stories; articles fetched more
    than article_days ago that aren't quarantined, cited by what stays or goes, or in a cluster. The
    verification log stays.
    """
    old = moment(as_of) - F.expr(f"interval '{story_days}' day")
    gone = stories.filter(F.col("created_at") < old).select("id")
    gone_facts = facts.join(gone, facts["story_id"] == gone["id"], "left_semi").select("id")
    gone_evidence = evidence.join(gone_facts, evidence["fact_id"] == gone_facts["id"], "left_semi").select("id")
    a = articles.filter((F.col("fetched_at") < moment(as_of) - F.expr(f"interval '{article_days}' day")) & (F.col("status") != "quarantined"))
    a = a.join(evidence.select(F.col("article_id").alias("id")), "id", "left_anti").join(members.select(F.col("article_id").alias("id")), "id", "left_anti").select("id")
    return {"stories": gone, "story_facts": gone_facts, "fact_evidence": gone_evidence, "llm_calls": calls.filter(F.col("created_at") < old).select("id"), "articles": a}


def retention_counts(removed: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of a dry run."""
    out = None
    for name, ids in removed.items():
        n = ids.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    """A table after retention."""
    return table.join(ids, "id", "left_anti")
