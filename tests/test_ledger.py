"""The request ledger against a sequential loop, and sums along an order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import health, ledger
from newsloom.operators.ordered import numbered_along, ranged, running_total
from newsloom.schemas import LLM_CALLS, RESPONSE_CACHE

T0 = datetime.datetime(2025, 1, 30)
AS_OF = datetime.datetime(2025, 3, 1)
REQUESTS = "id long, purpose string, cache_key string, model string, prompt_version string, created_at timestamp_ntz"
RESPONSES = "cache_key string, attempt int, response_text string, input_tokens long, output_tokens long, latency_ms long"


def in_turn(requests, responses, cached, before, daily, monthly):
    """What a loop over the requests does: (id, attempt, status, cost), and hits by key."""
    spent, rows, hits, stored = list(before), [], {}, set(cached)
    for i, _, key, model, _, at in sorted(requests, key=lambda r: (r[5], r[0])):
        if key in stored:
            hits[key] = hits.get(key, 0) + 1
            rows.append((i, 1, "cache_hit", 0.0))
            continue
        day = sum(c for t, c in spent if t.date() == at.date())
        month = sum(c for t, c in spent if (t.year, t.month) == (at.year, at.month))
        if day >= daily or month >= monthly:
            rows.append((i, 1, "budget_exceeded", 0.0))
            continue
        tries = sorted(r for r in responses if r[0] == key)
        for _, attempt, text, n_in, n_out, _ in tries:
            cost = n_in * health.PRICES[model][0] + n_out * health.PRICES[model][1]
            spent.append((at, cost))
            good = text.startswith(("{", "```"))
            rows.append((i, attempt, "ok" if good else "rejected", cost))
            if good:
                stored.add(key)
                break
        if not tries:
            rows.append((i, 1, "rejected", 0.0))
    return sorted(rows), hits


@pytest.mark.parametrize(("seed", "daily", "monthly"), [(1, 0.02, 0.06), (2, 0.01, 1.0), (3, 1.0, 0.05), (4, 9.0, 9.0)])
def test_ledger_against_a_loop(spark, seed, daily, monthly):
    r = random.Random(seed)
    keys = [f"k{i}" for i in range(25)]
    requests = [(i, "p", r.choice(keys), "large", "v", T0 + datetime.timedelta(minutes=r.randrange(8 * 24 * 60))) for i in range(220)]
    responses = []
    for k in keys[:-1]:
        fails = r.choice([0, 0, 0, 1, 2])
        responses += [(k, a, '```json\n{"a": 1}\n```' if a > fails else "no", r.randrange(100, 900), r.randrange(10, 90), 5) for a in range(1, 3 if fails else 2)]
    cached = keys[:3]
    before = [(T0, daily / 2)]
    calls = spark.createDataFrame([(900, "p", "large", "v", 1, 1, daily / 2, 1, "ok", T0)], LLM_CALLS)
    cache = spark.createDataFrame([(k, "p", "large", "v", "{}", 1, 1, 0, AS_OF, None) for k in cached] + [("k5", "p", "large", "v", "{}", 1, 1, 4, AS_OF - datetime.timedelta(days=31), None)], RESPONSE_CACHE)
    rows, answers, after = ledger.request_ledger(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(responses, RESPONSES), cache, calls, health.Budgets(daily, monthly), AS_OF)
    want, hits = in_turn(requests, responses, cached, before, daily, monthly)
    got = sorted((x.id, x.attempt, x.status, x.cost_usd) for x in rows.collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))
    good = {x[0] for x in want if x[2] in ("ok", "cache_hit")}
    assert {x.id for x in answers.collect()} == good and all(x.response_text in ("{}", '{"a": 1}') for x in answers.collect())
    kept = {x.cache_key: x.hit_count for x in after.collect()}
    paid = {q[2] for q in requests if (q[0], "ok") in {(x[0], x[2]) for x in want}}
    assert kept == {k: hits.get(k, 0) + (4 if k == "k5" else 0) for k in {*cached, "k5", *paid}}


def test_two_requests_of_one_key(spark):
    requests = spark.createDataFrame([(i, "p", "k", "small", "v", T0) for i in (1, 2)], REQUESTS)
    responses = spark.createDataFrame([("k", '{"a": 1}', 100, 10, 5)], "cache_key string, response_text string, input_tokens long, output_tokens long, latency_ms long")
    none = spark.createDataFrame([], RESPONSE_CACHE)
    rows, _, after = ledger.request_ledger(requests, responses, none, spark.createDataFrame([], LLM_CALLS), health.Budgets(1, 10), AS_OF)
    assert [(x.status, x.cost_usd > 0) for x in rows.orderBy("id").collect()] == [("ok", True), ("cache_hit", False)]
    assert after.first().hit_count == 1


def test_sums_along_an_order(spark):
    rows = [(i * 37 % 1000, "ab"[i % 2], i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(7)
    got = [x.n for x in numbered_along(df, [F.col("k").desc()], "n").orderBy(F.desc("k")).collect()]
    assert got == list(range(1, 1001))
    order = [F.col("g"), F.col("k")]
    out = {x.k: x.s for x in running_total(ranged(df, order), order[1:], F.col("v"), "s", ["g"]).collect()}
    want, sums = {}, {}
    for k, g, v in sorted(rows, key=lambda x: (x[1], x[0])):
        want[k] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    assert out == want
    assert numbered_along(df.limit(0), [F.col("k")], "n").count() == 0


def test_one_day_with_all_requests_is_spread(spark):
    """A day's rows lie in every range, and no window holds more than a range."""
    rows = spark.range(4000).select("id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("created_at"), F.lit(0.001).alias("cost_usd"))
    sizes = [x["count"] for x in ranged(rows, [F.col("created_at"), F.col("id")], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 4 * min(sizes)
    assert ledger.budget_admission(rows, None, 1.0, 9.0).filter("admitted").count() == 1000


def test_keys_meet_the_cache_once(spark):
    """The cache after a batch is one join of the cache and the keys that were met; what neither holds nor pays is left out."""
    requests = spark.range(50).select("id", F.lit("p").alias("purpose"), F.concat(F.lit("k"), F.col("id") % 30).alias("cache_key"), F.lit("small").alias("model"), F.lit("v").alias("prompt_version"), F.lit(T0).cast("timestamp_ntz").alias("created_at"))
    responses = spark.range(30).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.lit('{"a": 1}').alias("response_text"), F.lit(100).alias("input_tokens"), F.lit(10).alias("output_tokens"), F.lit(5).cast("long").alias("latency_ms"))
    cache = spark.createDataFrame([("k1", "p", "large", "v", "{}", 1, 1, 3, AS_OF, None), ("other", "p", "large", "v", "{}", 1, 1, 2, AS_OF, None)], RESPONSE_CACHE)
    after = ledger.request_ledger(requests, responses, cache, spark.createDataFrame([], LLM_CALLS), health.Budgets(1, 10), AS_OF)[2]
    got = {r.cache_key: (r.model, r.hit_count, r.last_hit_at is not None) for r in after.collect()}
    assert len(got) == 31 and got["other"] == ("large", 2, False) and got["k1"] == ("large", 5, True) and got["k2"] == ("small", 1, True) and got["k25"] == ("small", 0, False)
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
