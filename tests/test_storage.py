"""What jobs write: retention by period, digests, streams that are run again, connectors."""

import datetime
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import evaluate, feed, retention
from newsloom.plans import queries
from newsloom.sources import connectors
from newsloom.streaming import jobs

T0 = datetime.datetime(2025, 1, 1)
AS_OF = datetime.datetime(2025, 1, 4)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_retention_touches_only_days_that_lose_rows(spark, tmp_path):
    rows = [(i, i % 5, T0 + datetime.timedelta(days=i % 4)) for i in range(40)] + [(100, 0, None), (101, 0, None)]
    path = str(tmp_path / "stories")
    retention.write_by_period(spark.createDataFrame(rows, "id long, v long, created_at timestamp_ntz"), path, "created_at")
    before = files(path)
    gone = [i for i in range(40) if i % 4 == 0] + [1, 5, 100, 999]  # all of the first day, two of the second, one without a day
    done = retention.apply_retention(spark, {"stories": path}, {"stories": spark.createDataFrame([(i,) for i in gone], "id long")})
    assert done == {"stories": {"rows": 13, "periods_deleted": 1, "periods_written": 2}}
    after = spark.read.parquet(path)
    assert {r.id for r in after.collect()} == {r[0] for r in rows} - set(gone) and sorted(after.columns) == ["created_at", "id", "period", "v"]
    kept = {f: t for f, t in before.items() if "2025-01-03" in f or "2025-01-04" in f}
    assert kept and kept.items() <= files(path).items() and not os.path.exists(f"{path}/period=2025-01-01")
    again = retention.apply_retention(spark, {"stories": path}, {"stories": spark.createDataFrame([(i,) for i in gone], "id long")})
    assert again == {"stories": {"rows": 0, "periods_deleted": 0, "periods_written": 0}} and kept.items() <= files(path).items()


def test_digest_files_in_order(spark, tmp_path):
    rows = [(i, T0 + datetime.timedelta(minutes=i % 7), f"## story {i}\n\nline of {i}\n---") for i in range(50)]
    digest = spark.createDataFrame(rows, "story_id long, created_at timestamp_ntz, text string").repartition(5)
    day, path = datetime.date(2025, 1, 1), str(tmp_path / "digest")
    for _ in range(2):  # written again, it is the same
        feed.write_digest(digest, day, path, files=4)
    feed.write_digest(digest.limit(0), datetime.date(2025, 1, 2), path)
    parts = sorted(files(f"{path}/day=2025-01-01"))
    text = "".join(open(p).read() for p in parts)
    want = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))
    assert text == "# Digest — 2025-01-01\n\n" + "".join(r[2] + "\n" for r in want) and len(parts) == 4
    assert text.strip() == feed.digest_text(digest, day).first().value.strip()


def test_quantiles_are_exact(spark):
    r = random.Random(3)
    for n in (0, 1, 2, 7, 500):
        v = sorted(r.choice([r.random(), 0.5]) for _ in range(n))
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").repartition(3)
        for q in (0.0, 0.5, 0.9, 1.0):
            got, want = evaluate.quantile(df, "v", q, "x").first().x, df.agg(F.percentile("v", q)).first()[0]
            assert (got is None and want is None) or abs(got - want) < 1e-12


def test_stream_batch_run_again_writes_the_same(spark, tmp_path):
    """A repeat lands before, within and after the state's time; a batch whose commit is lost is run again."""
    src = spark.createDataFrame([(1, "feed", "rss", False, True)], schemas.SOURCES)
    land, table, ckpt = (str(tmp_path / x) for x in ("land", "articles", "ckpt"))
    spark.createDataFrame([], schemas.ARTICLES).write.parquet(table)
    item = lambda title, url, hours, arrival: ("feed", title, url, T0, None, "p", [], None, None, None, arrival, T0 + datetime.timedelta(hours=hours))
    slices = [[item("b", "http://x.org/1", 1, 7), item("a", "http://www.x.org/1/", 1, 6), item("c", "http://x.org/2", 2, 8)], [item("d", "http://x.org/1?utm_source=z", 3, 9)], [item("e", "http://x.org/3", 50, 10)], [item("f", "http://x.org/2", 60, 11), item("g", "http://x.org/4", 60, 12)]]
    for rows in slices:
        spark.createDataFrame(rows, jobs.LANDED).coalesce(1).write.mode("append").json(land)
        jobs.stream_ingest(spark, land, src, table, ckpt, AS_OF, keep_ms=3_600_000, delay="30 hours").awaitTermination(120)
    want = {(r.canonical_url, r.title, r.fetched_at) for r in jobs.stored_articles(spark, table).collect()}
    assert {(u[-1], t) for u, t, _ in want} == {("1", "a"), ("2", "c"), ("3", "e"), ("4", "g")}
    assert {f for _, _, f in want} == {T0 + datetime.timedelta(hours=h) for h in (1, 2, 50, 60)}
    last = max(int(f) for f in os.listdir(f"{ckpt}/commits") if f.isdigit())
    for f in (f"{ckpt}/commits/{last}", f"{ckpt}/commits/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    jobs.stream_ingest(spark, land, src, table, ckpt, AS_OF, keep_ms=3_600_000, delay="30 hours").awaitTermination(120)
    assert {(r.canonical_url, r.title, r.fetched_at) for r in jobs.stored_articles(spark, table).collect()} == want


def test_connectors_fail_alone(spark, tmp_path):
    rows = spark.createDataFrame([("x", "t", "http://x.org", T0, None, None, [], None, None, None)], schemas.RAW_ARTICLES.rsplit(",", 1)[0])

    def broken(spark, as_of):
        raise ValueError("no such feed")

    made = [connectors.Connector("bad", "api", broken), connectors.Connector("x", "rss", lambda spark, as_of: rows), connectors.rss("gone", str(tmp_path / "none")), connectors.Connector("off", "rss", broken, enabled=False)]
    raw, errors = connectors.fetched(spark, made, AS_OF)
    assert [(r.source, r.title) for r in raw.collect()] == [("x", "t")]
    assert sorted(r.source for r in errors.collect()) == ["bad", "gone"] and errors.filter("source = 'bad'").first().error == "ValueError: no such feed"
    assert {(r.name, r.kind, r.enabled) for r in connectors.source_table(spark, made).collect()} == {("bad", "api", True), ("x", "rss", True), ("gone", "rss", True), ("off", "rss", False)}
    assert connectors.fetched(spark, [], AS_OF)[0].count() == 0


def test_stream_state_is_given_few_columns():
    """It is called for each URL: a row comes and goes as one text, the earliest to land (then to arrive) first."""

    class State:
        hasTimedOut, exists, value, timeout = False, False, None, None

        def update(self, value):
            self.value, self.exists = value, True

        def setTimeoutTimestamp(self, at):
            self.timeout = at

        def getCurrentWatermarkMs(self):
            return 0

    state, run = State(), jobs._first_writer(1000)
    part = lambda *rows: pd.DataFrame(rows, columns=["landed", "arrival", "row"])
    out = list(run(("u",), iter([part((9_000, 1, "late"), (7_000, 5, "b")), part((7_000, 4, "a"))]), state))
    assert [x.to_dict("list") for x in out] == [{"row": ["a"]}] and state.value == (7,) and state.timeout == 1009
    assert list(run(("u",), iter([part((1_000, 1, "again"))]), state)) == []


def test_filings_land_in_one_folder(spark, tmp_path):
    """A file for each 100 customers, no folder of its own for each; keys are landed without filings."""
    rows = spark.range(1000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 450).alias("o_custkey"), F.lit(T0).cast("timestamp_ntz").alias("o_orderdate"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    for land in (queries._land_filings, queries._land_ciks):
        path = land(spark, str(tmp_path)).removeprefix("file:")
        found = files(path)
        assert len(found) == 5 and all(os.path.dirname(f) == path for f in found)
    assert queries.cik_keys(spark, str(tmp_path)).count() == sum(c % 4 != 0 for c in range(450))


def test_urls_states_are_kept_in_buckets():
    """Of many URLs in one call, each keeps its first row and its own time; the earliest time is the bucket's."""

    class State:
        hasTimedOut, exists, get, timeout, now = False, False, None, None, 0

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.get, self.exists = None, False

        def setTimeoutTimestamp(self, at):
            self.timeout = at

        def getCurrentWatermarkMs(self):
            return self.now

    state, run = State(), jobs._first_writers(1000)
    call = lambda *rows: [x for out in run((0,), iter([pd.DataFrame(rows[:2], columns=names), pd.DataFrame(rows[2:], columns=names)]), state) for x in out["row"]]
    names = ["url_key", "landed", "arrival", "row"]
    assert sorted(call(("u", 9_000, 1, "late"), ("v", 5_000_000, 2, "v1"), ("u", 7_000, 4, "a"), ("u", 7_000, 5, "b"))) == ["a", "v1"] and state.timeout == 1009
    assert call(("u", 1_000, 1, "again"), ("w", 3_000, 9, "w1")) == ["w1"] and state.timeout == 1001
    state.now, state.hasTimedOut = 2000, True
    assert list(run((0,), iter([]), state)) == [] and state.timeout == 6000  # u and w are forgotten, v is held
    state.hasTimedOut = False
    assert call(("u", 2_500_000, 1, "u2"), ("v", 2_500_000, 1, "v2")) == ["u2"]
    state.now, state.hasTimedOut = 9000, True
    assert list(run((0,), iter([]), state)) == [] and not state.exists
