"""WARC: resolving not-modified revisits.

A revisit record says that a page had not changed when it was fetched again; its content is that of the
latest full response of the same canonical URL before it. Records are (record_id, url, ts, revisit,
status, headers, payload...): `revisit` marks revisit records, headers is a map of any letter case.

1. Header names become lower-case; of repeated names the last one counts.
2. As-of join by canonical URL: responses with status 200 are candidates, the latest strictly earlier
   one by (ts, record_id) is the target. No window runs over all records of a URL: records fall into
   periods of `period` seconds, each period's last response is aggregated (summed up map-side first) and
   carried over the periods of a URL, and only records of one URL and period are ordered together.
3. Validators: an ETag of the revisit must equal the target's (weak comparison); if the revisit has no
   ETag, its Last-Modified must equal the target's; without either the target is taken unvalidated.
4. Headers of a resolved revisit are the target's, updated by those a not-modified response may change.

Only ids, times and validators go through the as-of join; payloads are joined by target id at the end.

Defined cases: a null url or ts never resolves (`no_earlier_response`); null headers are empty; equal
times are ordered by record_id, and a response with the revisit's own time counts as earlier only if its
record_id is smaller; repeated revisits resolve alike, and revisits of one record_id but different URLs or
times each by their own; repeated responses with one record_id count as one, the earliest; a null revisit
is a response; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import canonical_url, canonical_url_sql

#: Headers that a not-modified response may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified"]


def tidy_headers(headers: Column) -> Column:
    """Lower-case names; the last of repeated ones."""
    items = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(items, lambda e, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merged_headers(target: Column, revisit: Column) -> Column:
    """The target's headers with the permitted ones of the revisit in their place."""
    update = F.map_filter(revisit, lambda k, v: k.isin(PERMITTED))
    return F.map_concat(F.map_filter(target, lambda k, v: ~F.map_contains_key(update, k)), update)


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def latest_earlier(records: DataFrame, period: int = 86_400) -> DataFrame:
    """(record_id, curl, ts, target_id) of each revisit; records need record_id, curl, ts, revisit, full."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (period * 1_000_000)).cast("long")
    r = records.filter("curl is not null and ts is not null").select("record_id", "curl", "ts", "revisit", "full", bucket.alias("bucket"))
    key = F.struct("ts", "record_id")
    # Periods in use, each with the last response of an earlier period.
    used = r.groupBy("curl", "bucket").agg(F.max(F.when(F.col("full"), key)).alias("last"))
    earlier = Window.partitionBy("curl").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = used.withColumn("carried", F.max("last").over(earlier)).select("curl", "bucket", "carried")
    inside = Window.partitionBy("curl", "bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = r.withColumn("before", F.max(F.when(F.col("full"), key)).over(inside))
    both = own.filter("revisit").join(carried, ["curl", "bucket"])
    return both.select("record_id", "curl", "ts", F.coalesce("before.record_id", "carried.record_id").alias("target_id"))


def resolve_revisits(records: DataFrame, period: int = 86_400) -> DataFrame:
    """record_id, target_id, outcome, headers of each revisit.

    outcome: validated, unvalidated, etag_mismatch, modified or no_earlier_response; target_id and
    headers are null unless resolved (the first two).
    """
    tidy = records.select("record_id", canonical_url(F.col("url").cast("string")).alias("curl"), "ts", F.coalesce("revisit", F.lit(False)).alias("revisit"), F.col("status").cast("int").alias("status"), tidy_headers(F.col("headers")).alias("headers"))
    tidy = tidy.withColumn("full", F.coalesce(~F.col("revisit") & (F.col("status") == 200), F.lit(False)))
    at = latest_earlier(tidy, period).distinct()
    targets = tidy.filter("full").groupBy("record_id").agg(F.min_by("headers", F.col("ts")).alias("target_headers")).withColumnRenamed("record_id", "target_id")
    both = tidy.filter("revisit").join(at, ["record_id", "curl", "ts"], "left").join(targets, "target_id", "left")
    mine = lambda k: F.col("headers")[k]
    theirs = lambda k: F.col("target_headers")[k]
    outcome = (
        F.when(F.col("target_headers").isNull(), "no_earlier_response")
        .when(mine("etag").isNotNull(), F.when(weak(mine("etag")).eqNullSafe(weak(theirs("etag"))), "validated").otherwise("etag_mismatch"))
        .when(mine("last-modified").isNotNull(), F.when(mine("last-modified").eqNullSafe(theirs("last-modified")), "validated").otherwise("modified"))
        .otherwise("unvalidated")
    )
    both = both.withColumn("outcome", outcome)
    good = F.col("outcome").isin("validated", "unvalidated")
    return both.select("record_id", F.when(good, F.col("target_id")).alias("target_id"), "outcome", F.when(good, merged_headers(F.col("target_headers"), F.col("headers"))).alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame, payload: str) -> DataFrame:
    """Resolved revisits beside their target's payload (of responses with one record_id, the earliest's)."""
    full = records.filter(~F.coalesce("revisit", F.lit(False)) & (F.col("status").cast("int") == 200))
    content = full.groupBy(F.col("record_id").alias("target_id")).agg(F.min_by(payload, F.col("ts")).alias(payload))
    return resolved.filter("target_id is not null").join(content, "target_id")


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log that follows from `pages`: each page is a full response, and was fetched again.

    Page p is fetched at 2024-01-01 plus p minutes. Two of three pages are revisited, after 1 to 7200
    minutes, with an ETag (every seventh a new one), a Last-Modified, or no validator at all.
    """
    p = F.col("page_id").cast("long")
    at = lambda minutes: F.timestamp_seconds(F.lit(1_704_067_200) + F.lit(60) * minutes).cast("timestamp_ntz")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    made = F.concat(F.lit("day "), F.floor(p / 1440).cast("string"))
    first = pages.select(
        (p * 2).alias("record_id"), "url", at(p).alias("ts"), F.lit(False).alias("revisit"), F.when(p % 11 == 0, 503).otherwise(200).alias("status"),
        F.create_map(F.lit("ETag"), F.concat(F.lit('W/"'), digest, F.lit('"')), F.lit("Last-Modified"), made, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), p.cast("string")).alias("headers"),
    )
    date = [F.lit("DATE"), (p + 1).cast("string"), F.lit("Content-Length"), F.lit("0")]
    tag = F.concat(F.lit('"'), F.when(p % 7 == 0, F.lit("new")).otherwise(digest), F.lit('"'))
    headers = F.when(p % 5 == 0, F.create_map(*date)).when(p % 5 == 1, F.create_map(F.lit("last-modified"), made, *date)).otherwise(F.create_map(F.lit("etag"), tag, *date))
    again = pages.filter(p % 3 != 0).select((p * 2 + 1).alias("record_id"), "url", at(p + 1 + (p * 37) % 7200).alias("ts"), F.lit(True).alias("revisit"), F.lit(304).alias("status"), headers.alias("headers"))
    return first.unionByName(again)


def revisit_report(pages: DataFrame) -> DataFrame:
    """record_id, target_id, outcome and the merged headers, sorted by name as one string."""
    r = resolve_revisits(capture_log(pages))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return r.select("record_id", "target_id", "outcome", said.alias("merged"))


SQL = f"""
with p as (select page_id::bigint as p, {canonical_url_sql('url')} as curl, md5(coalesce(html, '')) as digest, 'day ' || (page_id // 1440)::varchar as made from pages),
full_ as (select p * 2 as record_id, curl, timestamp '2024-01-01' + to_minutes(p) as ts, '"' || digest || '"' as etag, made, p from p where p % 11 <> 0),
again as (
  select p * 2 + 1 as record_id, curl, timestamp '2024-01-01' + to_minutes(p + 1 + (p * 37) % 7200) as ts, p,
    case when p % 5 > 1 then '"' || case when p % 7 = 0 then 'new' else digest end || '"' end as etag,
    case when p % 5 = 1 then made end as made
  from p where p % 3 <> 0),
met as (
  select a.record_id, a.etag, a.made, a.p, f.record_id as target_id, f.etag as fetag, f.made as fmade,
    row_number() over (partition by a.record_id order by f.ts desc, f.record_id desc) as rn
  from again a left join full_ f on a.curl = f.curl and (f.ts < a.ts or (f.ts = a.ts and f.record_id < a.record_id))),
told as (
  select *, case when target_id is null then 'no_earlier_response'
    when etag is not null then case when etag = fetag then 'validated' else 'etag_mismatch' end
    when made is not null then case when made = fmade then 'validated' else 'modified' end
    else 'unvalidated' end as outcome from met where rn = 1)
select record_id, case when outcome in ('validated', 'unvalidated') then target_id end as target_id, outcome,
  case when outcome in ('validated', 'unvalidated') then
    'content-type=text/html; date=' || (p + 1)::varchar || '; etag=' || coalesce(etag, 'W/' || fetag) || '; last-modified=' || coalesce(made, fmade) end as merged
from told
"""
