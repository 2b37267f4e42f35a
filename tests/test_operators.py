import datetime
import json

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import clusters, corroborate, evaluate, feed, health, ledger, stories, verify
from newsloom.sources import ingest, readers
from newsloom.streaming import jobs

T0 = datetime.datetime(2025, 1, 1)
AS_OF = datetime.datetime(2025, 1, 2)


def hours(h):
    return T0 + datetime.timedelta(hours=h)


def articles(spark, rows):
    """rows: id, title, text, publisher, tickers, hours."""
    data = [(i, 1, p, t, s, f"http://x.org/{i}", f"http://x.org/{i}", hours(h), hours(h), k, f"h{hash((t, s))}", None, 0.0, [], "active", None, None, None) for i, t, s, p, k, h in rows]
    return spark.createDataFrame(data, schemas.ARTICLES)


def no(spark, ddl):
    return spark.createDataFrame([], ddl)


def test_dedup(spark):
    text = "shares of the company rose after strong results on monday morning in new york"
    a = articles(spark, [(1, "t", text, "p1", ["NV"], 1), (2, "t", text, "p2", ["NV"], 2), (3, "t", text, "", ["NV"], 3), (4, "t", text + " again", "p1", ["NV"], 4), (5, "t", text + " today", "p3", ["NV"], 5), (6, "else", "quite another thing", None, [], 6), (7, "t", text + " x", "p", ["ZZ"], 7)])
    members = no(spark, schemas.CLUSTER_MEMBERS)
    c, m, s = clusters.dedup(a, members, AS_OF)
    by = {}
    for r in m.collect():
        by.setdefault((r.match_method, r.cluster_id), set()).add(r.article_id)
    groups = sorted((k[0], sorted(v)) for k, v in by.items())
    assert groups == [("exact_hash", [1, 2, 3]), ("minhash", [4, 5]), ("solo", [6]), ("solo", [7])]
    exact = [r for r in c.collect() if r.article_count == 3][0]
    assert exact.publisher_count == 2 and exact.primary_ticker == "NV" and exact.first_seen_at == hours(1) and exact.last_seen_at == hours(3)
    assert s.first().asDict() == {"processed": 7, "quarantined": 0, "exact_clusters": 1, "near_clusters": 1, "solo_clusters": 2}
    again = clusters.dedup(a, m, AS_OF)
    assert again[1].count() == 0
    edges = clusters.near_dup_edges(a, members, AS_OF)
    exact_pairs = {(r.id_a, r.id_b) for r in edges.collect()}
    assert {(r.id_a, r.id_b) for r in clusters.banded_edges(a, members, AS_OF).collect()} <= exact_pairs
    assert clusters.greedy_clusters(edges, a)[1].count() == 5


def test_merge(spark):
    a = articles(spark, [(1, "a", "", "p1", [], 1), (2, "b", "", "p2", [], 2), (3, "c", "", "p2", [], 3)])
    c = spark.createDataFrame([(10, "T", hours(1), hours(1), 1, 1), (20, "T", hours(2), hours(3), 2, 1), (30, "T", hours(5), hours(5), 1, 1)], "id long, primary_ticker string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, article_count long, publisher_count long")
    m = spark.createDataFrame([(10, 1, "solo", 1.0, True), (20, 2, "minhash", 0.6, True), (20, 3, "minhash", 0.6, True), (20, 1, "minhash", 0.6, True), (30, 3, "solo", 1.0, False)], schemas.CLUSTER_MEMBERS)
    assert [tuple(r) for r in clusters.border_pairs(c, m, AS_OF).collect()] == [(10, 20)]
    v = spark.createDataFrame([(10, 20, True, 0.8), (10, 30, True, 0.79)], "a long, b long, same_event boolean, confidence double")
    c2, m2 = clusters.merge_clusters(c, m, a, v)
    got = {r.id: (r.article_count, r.publisher_count, r.first_seen_at, r.last_seen_at) for r in c2.collect()}
    assert got == {10: (3, 2, hours(1), hours(3)), 30: (1, 1, hours(5), hours(5))}
    assert m2.filter("cluster_id = 10").count() == 3


def test_requests_for_pairs_judgements_and_rechecks(spark):
    a = articles(spark, [(1, "a", "one", "p", [], 1), (2, "b", "two", "p", [], 2), (3, "c", "gone", "p", [], 3), (4, "", "", "p", [], 4)])
    a = a.withColumn("status", F.when(F.col("id") == 3, "quarantined").otherwise(F.col("status"))).withColumn("injection_score", F.when(F.col("id") == 2, 0.0).otherwise(0.2))
    c = spark.createDataFrame([(10, "T"), (20, None), (30, "T")], "id long, primary_ticker string")
    m = spark.createDataFrame([(10, 1), (10, 3), (20, 1), (20, 2), (20, 2), (30, 3), (30, 4)], "cluster_id long, article_id long")
    pairs = spark.createDataFrame([(10, 20), (10, 20)], "a long, b long")
    (r,) = clusters.same_event_requests(pairs, c, m, a).collect()
    assert (r.a, r.b) == (10, 20) and r.user_msg.count("<article ") == 3 and "cluster 20 (primary ticker: N/A)" in r.user_msg and "gone" not in r.user_msg
    assert clusters.same_event_requests(pairs.selectExpr("a", "30 as b"), c, m.filter("article_id = 3 or cluster_id < 30"), a).count() == 0

    f = spark.createDataFrame([(1, 1, 0, "x \"y\"", "pending"), (2, 1, 1, "z", "pending"), (3, 1, 2, "w", "removed"), (4, 1, 3, "v", "pending")], "id long, story_id long, fact_order int, text_bg string, verification_status string")
    log = spark.createDataFrame([(k, "opinion_placement", k == 4) for k in (1, 1, 2, 3, 4)], "fact_id long, check string, passed boolean")
    e = spark.createDataFrame([(8, 1, 1, "second"), (7, 1, 1, "first"), (9, 3, 1, "no")], "id long, fact_id long, article_id long, quote_en string")
    told = {r.fact_id: json.loads(r.user_msg) for r in verify.judgement_requests(f, log, e).collect()}
    assert told == {1: {"fact_id": 1, "fact_text_bg": 'x "y"', "quotes": ["first", "second"]}, 2: {"fact_id": 2, "fact_text_bg": "z", "quotes": []}}
    # In the grey zone, active, in a cluster, and not blank: the first article alone, once.
    assert [r.article_id for r in verify.recheck_requests(a, m).collect()] == [1]


def test_corroboration(spark):
    src = spark.createDataFrame([(1, "m", "rss", False, True), (2, "sec", "primary", True, True)], schemas.SOURCES)
    media = articles(spark, [(1, "t", "x", "p", ["NV"], 1), (2, "t", "y", "p", ["AB"], 1)])
    sec = articles(spark, [(3, "f", None, "s", ["NV"], 10), (4, "f", None, "s", ["NV"], 100), (5, "f", None, "s", ["AB"], 2)])
    sec = sec.withColumns({"source_id": F.lit(2).cast("long"), "event_type_hint": F.when(F.col("id") == 5, "other").otherwise("earnings")})
    c = spark.createDataFrame([(10, "NV", hours(1), hours(1), "earnings"), (20, "AB", hours(1), hours(1), "legal")], "id long, primary_ticker string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, event_type string")
    c = c.withColumns({"article_count": F.lit(1).cast("long"), "publisher_count": F.lit(1).cast("long"), "has_primary_source": F.lit(False), "sec_filing_url": F.lit(None).cast("string"), "visible": F.lit(True)})
    m = spark.createDataFrame([(10, 1, "solo", 1.0, False), (20, 2, "solo", 1.0, False)], schemas.CLUSTER_MEMBERS)
    for said, ok in ((0.7, True), (0.69, False)):
        v = spark.createDataFrame([(5, 20, True, said)], "filing_id long, cluster_id long, matches boolean, confidence double")
        c2, m2, s = corroborate.corroborate(media.unionByName(sec), src, c, m, v)
        assert s.first().new_corroborations == 1 + ok and s.first().standalone == 2 - ok
        got = {r.id: (r.article_count, r.has_primary_source) for r in c2.collect()}
        assert got[10] == (2, True) and got[20] == (1 + ok, ok) and len(got) == 4 - ok
        again = corroborate.corroborate(media.unionByName(sec), src, c2, m2, v)
        assert again[1].count() == m2.count()


def test_verification_stops_at_the_first_failure(spark):
    a = articles(spark, [(1, "t", "Revenue rose to $3.5 billion, said “AMD”.", "p", [], 1)])
    facts = [(1, "Купете сега"), (2, "Приходите са $3,5 млрд."), (3, "Приходите са $4,5 млрд."), (4, "XYZ расте"), (5, "AMD очаква ръст"), (6, "Нищо")]
    f = spark.createDataFrame([(i, 1, i, t, "pending") for i, t in facts] + [(7, 1, 7, "старо", "verified")], schemas.STORY_FACTS)
    e = spark.createDataFrame([(i, i, 1, 'revenue rose to $3.5 billion, said "AMD"', 0, 1) for i, _ in facts[:-1]], schemas.FACT_EVIDENCE)
    done, log = verify.verify_facts(f, e, a, AS_OF)
    assert {r.id: r.verification_status for r in done.collect()} == {1: "removed", 2: "verified", 3: "removed", 4: "removed", 5: "pending", 6: "verified", 7: "verified"}
    assert {r.fact_id: r.n for r in log.groupBy("fact_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 5, 3: 3, 4: 4, 5: 5, 6: 5}
    v = spark.createDataFrame([(5, '{"fact_id": 5, "support": "supported"}')], "fact_id long, response_text string")
    assert verify.apply_judgements(done, log, v, AS_OF)[0].filter("id = 5").first().verification_status == "verified"
    assert verify.apply_judgements(done, log, v.limit(0), AS_OF)[0].filter("id = 5").first().verification_status == "partially_supported"
    s = spark.createDataFrame([(1, 1), (2, 2)], "id long, cluster_id long").withColumn("verification_status", F.lit("pending"))
    assert {r.id: r.verification_status for r in verify.story_status(s, done).collect()} == {1: "partial", 2: "verified"}


def test_feed_null_logic(spark):
    c = spark.createDataFrame([(1, True, None), (2, True, False), (3, True, True), (4, False, True)], "id long, visible boolean, is_main_subject boolean").withColumns({"last_seen_at": F.lit(T0).cast("timestamp_ntz"), "primary_ticker": F.lit("NV")})
    s = spark.createDataFrame([(i, i) for i in range(1, 5)], "id long, cluster_id long").withColumns({"is_opinion": F.lit(False), "tickers": F.array(F.lit("AMDOCS")), "title_bg": F.lit("t"), "summary_bg": F.lit("s"), "verification_status": F.lit("pending")})
    a, m = articles(spark, [(9, "t", "x", "p", [], 1)]), spark.createDataFrame([(1, 9, "solo", 1.0, False)], schemas.CLUSTER_MEMBERS)
    assert sorted(r.id for r in feed.story_feed(s, c, m, a, AS_OF, 48).collect()) == [1, 3]
    assert sorted(r.id for r in feed.story_feed(s, c, m, a, AS_OF, 48, hidden=True).collect()) == [1, 2, 3, 4]
    assert feed.story_feed(s, c, m, a, AS_OF, 48, ticker="amd").count() == 0
    assert feed.story_feed(s, c, m, a, AS_OF, 48, ticker="nv").count() == 2
    assert feed.funnel(a, c, AS_OF, 48).first().relevant == 1
    card = feed.story_display(feed.story_feed(s, c, m, a, AS_OF, 48)).filter("id = 1").first()
    assert card.title_bg is None and len(card.links) == 1


def test_budget_against_a_loop(spark):
    rows = [(i, T0 + datetime.timedelta(minutes=37 * i), (i * 7 % 11) / 8) for i in range(400)]
    spent_day, spent_month, want = {}, 0.0, {}
    for i, at, cost in rows:
        day = at.date()
        by_day = spent_day.get(day, 0.0) < 3.0
        want[i] = cost == 0 or (by_day and spent_month < 20.0)
        spent_day[day] = spent_day.get(day, 0.0) + cost
        spent_month += cost if by_day else 0.0
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, cost_usd double")
    got = {r.id: r.admitted for r in ledger.budget_admission(df, None, 3.0, 20.0).collect()}
    assert got == want


def test_health_and_retention(spark):
    src = spark.createDataFrame([(1, "a", "rss", False, True), (2, "b", "api", False, True), (3, "c", "api", False, True), (4, "off", "api", False, False)], schemas.SOURCES)
    runs = spark.createDataFrame([(1, 1, hours(0), hours(0), "ok"), (2, 1, hours(20), hours(20), "stale"), (3, 2, hours(-48), hours(-48), "ok")], "id long, source_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    got = {r.source_name: (r.status, r.stale_hours) for r in health.source_health(src, runs, AS_OF).collect()}
    assert got == {"a": ("ok", 24.0), "b": ("stale", 72.0), "c": ("never_fetched", None)}
    calls = spark.createDataFrame([(1, hours(1), 9.0)], "id long, created_at timestamp_ntz, cost_usd double")
    log = spark.createDataFrame([(1, None, "x", False, "", AS_OF), (1, None, "x", True, "", AS_OF)], schemas.VERIFICATION_LOG)
    kinds = sorted(r.type for r in health.alarms(health.source_health(src, runs, AS_OF), log, calls, health.Budgets(1, 10), AS_OF).collect())
    assert kinds == ["budget_warning", "high_rejection", "stale_source", "stale_source"]


def test_summaries_and_versions(spark):
    a = articles(spark, [(1, "t", "The text says so.", "p", ["NV"], 1), (2, "t", "Other text.", "p", ["NV"], 2)])
    c = spark.createDataFrame([(7, "NV", hours(5), None, None), (8, "NV", hours(5), None, None)], "id long, primary_ticker string, last_seen_at timestamp_ntz, event_type string, is_opinion boolean")
    m = spark.createDataFrame([(7, 1, "solo", 1.0, False), (7, 2, "solo", 1.0, False), (8, 1, "solo", 1.0, False)], schemas.CLUSTER_MEMBERS)
    body = lambda cid, aid, q: json.dumps({"cluster_id": cid, "title_bg": "t", "summary_bg": "s", "key_facts": [{"text_bg": "f", "evidence": [{"article_id": aid, "quote_en": q}]}], "attributed_opinions": [], "uncertainties_bg": [], "injection_suspected": False})
    r = spark.createDataFrame([(7, body(7, 1, "text says")), (8, body(8, 2, "Other"))], "cluster_id long, response_text string")
    s, f, e, bad = stories.apply_summaries(c, m, a, r, AS_OF)
    assert [(x.cluster_id, x.tickers) for x in s.collect()] == [(7, ["NV"])] and f.count() == 1
    assert [(x.quote_start, x.quote_end) for x in e.collect()] == [(4, 13)]
    assert [tuple(x) for x in bad.collect()] == [(8, "unknown article")]
    old = s.withColumn("created_at", F.lit(hours(1)).cast("timestamp_ntz"))
    stale = stories.stale_stories(c, old)
    v, s2, f2, e2 = stories.archive_stories(old, f, e, stale, no(spark, schemas.STORY_VERSIONS), AS_OF)
    row = v.first()
    assert row.version_num == 1 and json.loads(row.snapshot_json)["facts"][0]["quotes"][0]["quote_en"] == "text says"
    assert (s2.count(), f2.count(), e2.count()) == (0, 0, 0)


def test_readers(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x.org/1?utm_source=r</link><pubDate>Mon, 06 Oct 2025 14:30:00 +0000</pubDate><description></description></item><item><title></title><link>http://x.org/2</link></item><item><title>B</title><link>http://x.org/3</link><pubDate>soon</pubDate></item></channel></rss>")
    got = [(r.title, r.published_at, r.summary_raw, r.tickers) for r in readers.read_rss(spark, str(tmp_path / "f.xml"), "feed", AS_OF, "NV").orderBy("title").collect()]
    assert got == [("A", datetime.datetime(2025, 10, 6, 14, 30), None, ["NV"]), ("B", AS_OF, None, ["NV"])]
    (tmp_path / "n.json").write_text(json.dumps([{"datetime": 1735689600, "headline": "H", "related": "NV, AB,", "source": "S", "summary": " ", "url": "u"}, {"datetime": 0, "headline": " ", "url": "u"}]))
    got = [(r.title, r.published_at, r.tickers, r.summary_raw) for r in readers.read_news_json(spark, str(tmp_path / "n.json"), "n", AS_OF, "NV").collect()]
    assert got == [("H", T0, ["NV", "AB"], None)]
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1045810, "ticker": "nv", "title": "x"}}))
    ciks = readers.cik_lookup(spark, str(tmp_path / "t.json"))
    assert [tuple(r) for r in ciks.collect()] == [("NV", "0001045810")]
    recent = {"accessionNumber": ["1-2", "3-4", "5-6", "7-8"], "filingDate": ["2025-01-01", "bad", "2025-01-02", "2025-01-03"], "form": ["8-K", "10-Q", "4", "8-K"], "primaryDocument": list("abcd"), "items": ["9.01,2.02", "", "", ""]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1045810", "tickers": ["NV"], "filings": {"recent": recent}}))
    rows = readers.read_filings(spark, str(tmp_path / "s.json"), ciks, most=2).collect()
    assert [(r.title, r.url, r.event_type_hint, r.sec_items) for r in rows] == [("8-K NV — Financial Statements and Exhibits", "https://www.sec.gov/Archives/edgar/data/1045810/12/a", "earnings", ["9.01", "2.02"])]
    case = {"id": "i1", "category": "injection", "articles": [{"id": 1}], "must_not_include": []}
    (tmp_path / "g.json").write_text("\n".join(json.dumps(x) for x in (case, case | {"id": "i2", "expected_quarantined": True}, case | {"id": "n", "category": "normal", "articles": [{"id": 1}, {"id": 1}]})))
    good, bad = readers.load_golden(spark, str(tmp_path / "g.json"))
    assert [r.id for r in good.collect()] == ["i2"] and sorted(r.id for r in bad.collect()) == ["i1", "n"]


def test_ingest_is_idempotent_in_batch_and_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "feed", "rss", False, True)], schemas.SOURCES)
    rows = [("feed", "One", "http://x.org/1?utm_source=a", T0, "<p>x</p>", "p", ["NV"], None, None, None, 0), ("feed", "One again", "http://www.x.org/1/", T0, "y", "p", ["NV"], None, None, None, 1), ("feed", "", "http://x.org/2", T0, None, None, [], None, None, None, 2)]
    raw = spark.createDataFrame(rows, schemas.RAW_ARTICLES)
    new, runs = ingest.ingest(raw, no(spark, schemas.ARTICLES), src, AS_OF)
    got = new.collect()
    assert [(r.title, r.clean_text, r.status) for r in got] == [("One", "x", "active")]
    run = runs.first()
    assert (run.items_seen, run.items_new, run.status, run.newest_title) == (3, 1, "ok", "One")
    assert ingest.ingest(raw, new, src, AS_OF)[0].count() == 0
    errors = spark.createDataFrame([("feed", "x" * 2000)], "source string, error string")
    failed = ingest.ingest(raw.limit(0), new, src, AS_OF, errors=errors)[1].first()
    assert failed.status == "error" and len(failed.error) == 1000

    land, table = tmp_path / "land", tmp_path / "articles"
    no(spark, schemas.ARTICLES).write.parquet(str(table))
    for i in range(2):
        raw.coalesce(1).write.mode("append").json(str(land))
        jobs.stream_ingest(spark, str(land), src, str(table), str(tmp_path / "ckpt"), AS_OF).awaitTermination(120)
        assert jobs.stored_articles(spark, str(table)).count() == 1


def test_stream_cost_by_day(spark, tmp_path):
    rows = [(i, T0 + datetime.timedelta(hours=9 * i), "cache_hit" if i % 3 == 0 else "ok", 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, status string, cost_usd double")
    df.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "calls"))
    q = jobs.stream_cost_by_day(stream).writeStream.outputMode("update").format("memory").queryName("by_day").start()
    q.processAllAvailable()
    q.stop()
    got = {r.day: (r.calls, r.cache_hits, r.cost_usd) for r in spark.table("by_day").collect()}
    assert got == {r.day: (r.calls, r.cache_hits, r.cost_usd) for r in jobs.stream_cost_by_day(df).collect()} and len(got) == 4


def test_evaluation(spark):
    r = spark.createDataFrame(
        [("a", "normal", True, False, False, True, "силна покупка", 1.0, 10.0, None, ["тайна"]), ("b", "injection", None, True, False, False, None, 2.0, 30.0, "e", [])],
        "case_id string, category string, expected_is_opinion boolean, quarantined boolean, injection_suspected boolean, has_story boolean, story_text string, cost_usd double, latency_ms double, error string, must_not_include array<string>",
    )
    f = spark.createDataFrame([("a", 1, "ТАЙНА и 5%", "verified"), ("a", 2, "x", "removed")], "case_id string, fact_id long, text_bg string, verification_status string")
    e = spark.createDataFrame([("a", 1, "up 5%", "It went up 5% on Monday"), ("a", 1, "gone", "text")], "case_id string, fact_id long, quote_en string, article_text string")
    m = evaluate.hard_target_failures(evaluate.evaluate(r, f, e)).first()
    assert (m.quote_validity_rate, m.unsupported_fact_rate, m.leak_rate, m.injection_recall, m.injection_fpr, m.advice_leak, m.opinion_as_fact_rate) == (0.5, 0.5, 0.5, 1.0, 0.0, 1, 1.0)
    assert m.latency_p50_ms == 20.0 and m.cost_per_story_usd == 1.5 and m.failures == ["quote_validity_rate", "advice_leak", "leak_rate"]
