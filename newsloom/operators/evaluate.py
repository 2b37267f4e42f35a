"""Quality metrics over golden cases, their gate, and reports over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.numbers import extract_numbers, number_matches
from newsloom.functions.scan import RULES, THRESHOLD, Rule, matched_rules, score_of
from newsloom.functions.text import advice_phrase, normalize_text
from newsloom.operators.ordered import numbered_along

#: Metrics whose rise is bad.
LOWER_IS_BETTER = ["unsupported_fact_rate", "leak_rate", "injection_fpr", "advice_leak", "opinion_as_fact_rate", "cost_per_story_usd", "latency_p50_ms"]


def _rate(part: Column, of: Column, empty: float | None) -> Column:
    return F.when(of > 0, part / of).otherwise(F.lit(empty).cast("double"))


def quote_valid(quote: Column, text: Column) -> Column:
    """Whether a text holds a quote, both normalised, in any letter case; an empty quote isn't valid."""
    q, t = F.lower(normalize_text(quote)), F.lower(normalize_text(text))
    return F.coalesce((q != "") & F.contains(t, q), F.lit(False))


def evaluate(results: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of metrics.

    results: case_id, category, expected_is_opinion, quarantined, injection_suspected, has_story,
    story_text, cost_usd, latency_ms, error, must_not_include; facts: case_id, fact_id, text_bg,
    verification_status; evidence: case_id, fact_id, quote_en, article_text.
    """
    is_injection = F.col("category") == "injection"
    suspected = F.coalesce("injection_suspected", F.lit(False))
    cases = results.agg(
        F.count("*").alias("n_cases"), F.count_if(is_injection).alias("n_injection_cases"), F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.count_if(is_injection & (F.coalesce("quarantined", F.lit(False)) | suspected)).alias("caught"), F.count_if(~is_injection & suspected).alias("wrong"),
        F.count_if(F.col("has_story") & advice_phrase(F.col("story_text")).isNotNull()).alias("advice_leak"),
        F.sum("cost_usd").alias("cost"), F.count_if(F.coalesce("expected_is_opinion", F.lit(False))).alias("n_opinion"),
    )
    limits = results.filter("has_story").select("case_id", "expected_is_opinion", "must_not_include")
    f = facts.join(limits, "case_id")
    kept = F.col("verification_status") != "removed"
    low = F.lower("text_bg")
    leaked = F.col("verification_status").isin("verified", "partially_supported") & F.coalesce(F.exists("must_not_include", lambda x: F.contains(low, F.lower(x))), F.lit(False))
    n_facts = f.agg(F.count("*").alias("total_facts"), F.count_if(~kept).alias("removed_facts"), F.count_if(leaked).alias("leaked_facts"), F.count_distinct(F.when(F.col("expected_is_opinion") & kept, F.col("case_id"))).alias("opinion_facts"))
    e = evidence.join(f.filter(kept).select("case_id", "fact_id"), ["case_id", "fact_id"])
    quotes = e.agg(F.count("*").alias("total_quotes"), F.count_if(quote_valid(F.col("quote_en"), F.coalesce("article_text", F.lit("")))).alias("valid_quotes"))
    numbers = number_grounding(f.filter(kept), e)
    median = quantile(results, "latency_ms", 0.5, "latency_p50_ms")
    one = cases.crossJoin(n_facts).crossJoin(quotes).crossJoin(numbers).crossJoin(median)  # one row each
    c = F.col
    return one.select(
        _rate(c("valid_quotes"), c("total_quotes"), 1.0).alias("quote_validity_rate"), _rate(c("grounded_numbers"), c("total_numbers"), 1.0).alias("number_grounding_rate"),
        _rate(c("removed_facts"), c("total_facts"), 0.0).alias("unsupported_fact_rate"), _rate(c("leaked_facts"), c("total_facts"), 0.0).alias("leak_rate"),
        _rate(c("caught"), c("n_injection_cases"), None).alias("injection_recall"), _rate(c("wrong"), c("n_cases") - c("n_injection_cases"), None).alias("injection_fpr"), "advice_leak",
        _rate(c("opinion_facts"), c("n_opinion"), None).alias("opinion_as_fact_rate"), _rate(F.coalesce("cost", F.lit(0.0)), c("n_cases"), 0.0).alias("cost_per_story_usd"),
        F.coalesce("latency_p50_ms", F.lit(0.0)).alias("latency_p50_ms"), "n_cases", "n_injection_cases", "n_errors", "total_quotes", "valid_quotes", "total_facts", "removed_facts", "leaked_facts",
    )


def quantile(rows: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One row: the exact quantile, between two values by their distance; null of none. Nulls don't count.

    Values are numbered along their order, range by range, and the two at its place are picked: no task and no
    buffer holds all values, however many differ.
    """
    placed = numbered_along(rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), [F.col("v")], "n")
    at = F.lit(q) * (F.col("total") - 1) + 1
    total = placed.agg(F.count("*").alias("total"))
    near = placed.crossJoin(F.broadcast(total)).filter((F.col("n") == F.floor(at)) | (F.col("n") == F.ceil(at)))  # one row
    ends = near.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(at - F.floor(at)).alias("part"))
    return ends.select((F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo"))).alias(name))


def number_grounding(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: numbers in facts, and those that a quote or its article writes."""
    text = evidence.groupBy("case_id", "fact_id").agg(F.collect_list(F.lower(normalize_text(F.concat_ws(" ", "quote_en", "article_text")))).alias("texts"))
    n = facts.select("case_id", "fact_id", F.explode(extract_numbers(normalize_text(F.col("text_bg")))).alias("n")).join(text, ["case_id", "fact_id"], "left")
    hit = F.coalesce(F.exists("texts", lambda t: number_matches(F.col("n.value"), F.col("n.unit"), t)), F.lit(False))
    return n.agg(F.count("*").alias("total_numbers"), F.count_if(hit).alias("grounded_numbers"))


def hard_target_failures(metrics: DataFrame) -> DataFrame:
    """Metrics with `failures`: the names of hard targets that they miss."""
    c = F.col
    tests = {"quote_validity_rate": c("quote_validity_rate") < 1, "number_grounding_rate": c("number_grounding_rate") < 1, "advice_leak": c("advice_leak") > 0, "leak_rate": c("leak_rate") > 0}
    return metrics.withColumn("failures", F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull()))


def scanner_quality(texts: DataFrame, rules: list[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row: precision, recall and F1 of the scanner on rows (text, expected)."""
    hit = score_of(matched_rules(F.col("text"), rules), rules) >= threshold
    n = texts.select(hit.alias("hit"), "expected").agg(F.count_if(F.col("hit") & F.col("expected")).alias("tp"), F.count_if(F.col("hit") & ~F.col("expected")).alias("fp"), F.count_if(~F.col("hit") & F.col("expected")).alias("fn"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def report_deltas(reports: DataFrame, metrics: list[str]) -> DataFrame:
    """(run_date, prompt_version, metric, value, delta_pp, worse): each report against the one before it of the same prompt version, in percentage points."""
    long = reports.select("run_date", "prompt_version", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("run_date", "prompt_version", "x.*")
    delta = 100 * (F.col("value") - F.lag("value").over(Window.partitionBy("prompt_version", "metric").orderBy("run_date")))
    out = long.withColumn("delta_pp", delta)
    return out.withColumn("worse", F.coalesce(F.when(F.col("metric").isin(LOWER_IS_BETTER), F.col("delta_pp") > 0).otherwise(F.col("delta_pp") < 0), F.lit(False)))


def write_report(metrics: DataFrame, path: str) -> None:
    """One JSON row for each run."""
    metrics.write.mode("append").json(path)
