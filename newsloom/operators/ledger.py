"""The call ledger: cached responses, budget admission, costs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.responses import strip_fence
from newsloom.operators.health import PRICES, Budgets, moment
from newsloom.operators.ordered import ranged, running_total
from newsloom.session import staged


def _admission(requests: DataFrame, calls: DataFrame | None, daily: float, monthly: float) -> DataFrame:
    """Adds _by_day and _by_month, whether the spending before a request leaves room in each budget, and _day and _month.

    Spending never falls along a day, so the daily decision needs only the day's running sum, of all its
    requests; the monthly decision takes the running sum of those that the day admits. Both sums run along
    ranges of time (see `ordered`): a day that holds all requests is spread over all tasks.
    """
    day = F.col("created_at").cast("date")
    r = requests.withColumns({"_day": day, "_month": F.trunc(day, "MM")})
    zero = F.lit(0.0)
    if calls is None:
        r = r.withColumns({"_day0": zero, "_month0": zero})
    else:
        by_day = calls.groupBy(day.alias("_day")).agg(F.sum("cost_usd").alias("_day0"))
        by_month = calls.groupBy(F.trunc(day, "MM").alias("_month")).agg(F.sum("cost_usd").alias("_month0"))
        r = r.join(by_day, "_day", "left").join(by_month, "_month", "left").fillna(0.0, ["_day0", "_month0"])
    order = [F.col("created_at"), F.col("id")]
    r = running_total(ranged(r, order), order, F.col("cost_usd"), "_d", ["_month", "_day"])
    r = r.withColumn("_by_day", F.col("_day0") + F.col("_d") < daily)
    r = running_total(r, order, F.when(F.col("_by_day"), F.col("cost_usd")).otherwise(zero), "_m", ["_month"])
    return r.withColumn("_by_month", F.col("_month0") + F.col("_m") < monthly).select(*requests.columns, "_day", "_month", "_by_day", "_by_month")


def budget_admission(requests: DataFrame, calls: DataFrame | None, daily: float, monthly: float) -> DataFrame:
    """Adds `admitted` to requests (id, created_at, cost_usd): admitted while the spending before a
    request is below both caps; a request of no cost (a cached one) always is. `calls` is what the ledger
    holds already.
    """
    told = _admission(requests, calls, daily, monthly)
    return told.select(*requests.columns, ((F.col("cost_usd") == 0) | (F.col("_by_day") & F.col("_by_month"))).alias("admitted"))


def cached(requests: DataFrame, cache: DataFrame, as_of: datetime, ttl_days: int = 30) -> DataFrame:
    """Requests with `cached_text`, null on a miss. An entry of ttl_days whole days is too old; -1: never."""
    age = F.floor(F.expr("timestampdiff(SECOND, entry_at, as_of)") / 86400)
    c = cache.select("cache_key", F.col("response_text").alias("cached_text"), F.col("created_at").alias("entry_at")).withColumn("as_of", moment(as_of))
    fresh = c if ttl_days == -1 else c.filter(age < ttl_days)
    return requests.join(fresh.select("cache_key", "cached_text"), "cache_key", "left")


def cost_of(tier: Column, n_in: Column, n_out: Column) -> Column:
    prices = F.create_map(*[x for t, p in PRICES.items() for x in (F.lit(t), F.array(F.lit(p[0]), F.lit(p[1])))])
    return n_in * prices[tier][0] + n_out * prices[tier][1]


def _payers(asked: DataFrame, calls: DataFrame, budgets: Budgets) -> tuple[DataFrame, DataFrame]:
    """Which of `asked` (id, cache_key, created_at, cost_usd, valid) pay: (cache_key, paid_at) of keys with a valid response,
    paid_at being (created_at, id) of the one that pays; (id) of admitted requests, which tells those of other keys.

    A key's first admitted request pays, and makes its later ones hits. Which one that is depends on the
    spending before it, and so on other keys' payers. Start with each key's first request. A refused payer gives
    way to its key's first request of a later day (or month): budgets that are spent stay spent, so the
    others of that day would be refused too. No payer is ever placed later than it belongs: the spending
    assumed is never more than the true one, so what it refuses is refused. So the payers only move on, and
    where none moves they are right. Only a key's first request of a day counts, and each round reads
    just these. Keys without a valid response are never cached: all of their requests ask. Budgets are told by ids
    alone; keys, which are long, meet them again only where payers move.
    """
    first = asked.filter("valid").withColumn("day", F.col("created_at").cast("date")).groupBy("cache_key", "day").agg(F.min_by(F.struct("id", "created_at", "cost_usd"), F.struct("created_at", "id")).alias("r"))
    left = staged(first.select("cache_key", "day", "r.*"), "payers")
    always = asked.filter("not valid").select("id", "created_at", "cost_usd", F.lit(False).alias("keyed"))
    while True:
        payers = left.groupBy("cache_key").agg(F.min_by(F.struct("id", "created_at", "cost_usd"), "day").alias("r")).select("r.id", "cache_key", "r.created_at", "r.cost_usd")
        told = staged(_admission(payers.drop("cache_key").withColumn("keyed", F.lit(True)).unionByName(always), calls, budgets.daily, budgets.monthly), "admission")
        refused = told.filter(F.col("keyed") & ~(F.col("_by_day") & F.col("_by_month")))
        if refused.isEmpty():
            return payers.select("cache_key", F.struct("created_at", "id").alias("paid_at")), told.filter("_by_day and _by_month").select("id")
        past = payers.select("id", "cache_key").join(refused.select("id", F.when(F.col("_by_month"), F.col("_day")).otherwise(F.last_day("_day")).alias("upto")), "id").drop("id")
        left = staged(left.join(past, "cache_key", "left").filter("upto is null or day > upto").drop("upto"), "payers")


def attempts(responses: DataFrame) -> DataFrame:
    """(cache_key, tries, valid, response_text, n_tries): what a call gets, from responses by `attempt` (1 where there is no such column).

    An answer that isn't JSON is asked for once more, with its problem told; both are paid.
    """
    r = responses if "attempt" in responses.columns else responses.withColumn("attempt", F.lit(1))
    text = strip_fence(F.col("response_text"))
    r = r.filter("attempt <= 2").withColumns({"response_text": text, "valid": F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))})
    both = r.groupBy("cache_key").agg(F.sort_array(F.collect_list(F.struct("attempt", "valid", "response_text", "input_tokens", "output_tokens", "latency_ms"))).alias("tries"))  # two at most
    needed = F.when(F.col("tries")[0]["valid"], F.slice("tries", 1, 1)).otherwise(F.col("tries"))
    last = F.element_at("tries", -1)
    return both.withColumn("tries", needed).select("cache_key", "tries", last["valid"].alias("valid"), last["response_text"].alias("response_text"))


def request_ledger(requests: DataFrame, responses: DataFrame, cache: DataFrame, calls: DataFrame, budgets: Budgets, as_of: datetime, ttl_days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What happens to requests (id, purpose, cache_key, model, prompt_version, created_at), in the order of
    time and id, given responses (cache_key, response_text, input_tokens, output_tokens, latency_ms, and
    perhaps attempt, see `attempts`).

    A request finds what the cache holds, or what an earlier request of the batch has put there, and costs
    nothing then; else it is checked against the budgets, made and paid. Returns the ledger's new rows
    (status cache_hit, budget_exceeded, rejected or ok; a request made twice has two, `attempt` 1 and 2), the accepted
    responses (id, response_text), and the cache after it. Requests without a response are rejected at no cost.
    """
    spent = F.aggregate("tries", F.lit(0.0), lambda total, t: total + cost_of(F.col("model"), t["input_tokens"], t["output_tokens"]))
    met = cached(requests, cache, as_of, ttl_days).join(attempts(responses), "cache_key", "left")
    met = staged(met.withColumns({"cost_usd": F.coalesce(spent, F.lit(0.0)), "valid": F.coalesce("valid", F.lit(False))}), "requests")
    hit = F.col("cached_text").isNotNull()
    paid, admitted = _payers(met.filter(~hit).select("id", "cache_key", "created_at", "cost_usd", "valid"), calls, budgets)
    # A valid key's admitted payer comes with its place in time: what comes after it hits the cache. Each request is shuffled once.
    place = F.struct("created_at", "id")
    by_key = F.when(F.col("paid_at") == place, "ok").when(F.col("paid_at") < place, "cache_hit").otherwise("budget_exceeded")
    told = met.filter(hit).withColumn("status", F.lit("cache_hit"))
    told = told.unionByName(met.filter(~hit & F.col("valid")).join(paid, "cache_key", "left").withColumn("status", by_key).drop("paid_at"))
    told = told.unionByName(met.filter(~hit & ~F.col("valid")).join(admitted.withColumn("pays", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("pays"), "rejected").otherwise("budget_exceeded")).drop("pays"))
    told = staged(told, "told")

    none = F.array().cast("array<struct<attempt:int,valid:boolean,response_text:string,input_tokens:bigint,output_tokens:bigint,latency_ms:bigint>>")
    tries = F.when(F.col("status").isin("ok", "rejected"), F.coalesce("tries", none)).otherwise(none)
    rows = told.select("id", "purpose", "model", "prompt_version", "status", "created_at", F.explode_outer(tries).alias("t"))
    zero = lambda c: F.coalesce(F.col("t")[c], F.lit(0)).cast("long").alias(c)
    cost = F.when(F.col("t").isNull(), 0.0).otherwise(cost_of(F.col("model"), F.col("t.input_tokens"), F.col("t.output_tokens")))
    of_try = F.when(F.col("t").isNull(), F.col("status")).when(F.col("t.valid"), "ok").otherwise("rejected")
    ledger = rows.select("id", "purpose", "model", "prompt_version", zero("input_tokens"), zero("output_tokens"), F.coalesce(cost, F.lit(0.0)).alias("cost_usd"), zero("latency_ms"), of_try.alias("status"), "created_at", F.coalesce("t.attempt", F.lit(1)).cast("int").alias("attempt"))

    answers = told.filter(F.col("status").isin("ok", "cache_hit")).select("id", F.coalesce("cached_text", "response_text").alias("response_text"))
    last = F.element_at("tries", -1)
    new = F.struct("purpose", "model", "prompt_version", "response_text", last["input_tokens"].alias("input_tokens"), last["output_tokens"].alias("output_tokens"))
    ok = F.col("status") == "ok"
    # One row for each key that was met: what it got, if it paid, and its hits; it meets the cache once.
    keys = told.filter("status in ('ok', 'cache_hit')").groupBy("cache_key").agg(F.count_if(~ok).alias("more"), F.max(F.when(ok, new)).alias("new"))
    at, fresh, more = moment(as_of), F.col("new").isNotNull(), F.coalesce("more", F.lit(0))
    both = cache.withColumn("had", F.lit(True)).join(keys, "cache_key", "full").filter(F.col("had") | fresh)
    got = {c: F.when(fresh, F.col("new")[c]).otherwise(F.col(c)) for c in ("purpose", "model", "prompt_version", "response_text", "input_tokens", "output_tokens")}
    got["created_at"] = F.when(fresh, at).otherwise(F.col("created_at"))
    got["last_hit_at"] = F.when(more > 0, at).when(~fresh, F.col("last_hit_at"))
    got["hit_count"] = F.coalesce("hit_count", F.lit(0)).cast("long") + more
    return ledger, answers, both.withColumns(got).select(cache.columns)


def outcome_counts(ledger: DataFrame) -> DataFrame:
    """(purpose, status, requests)."""
    return ledger.groupBy("purpose", "status").agg(F.count("*").alias("requests"))
