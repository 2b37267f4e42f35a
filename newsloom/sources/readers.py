"""Readers of landed feeds: news feeds in XML and JSON, filings, ticker maps, golden cases.

Every reader returns rows of schemas.RAW_ARTICLES without `arrival`. Times that can't be read become the
given ingest time, but for filings, whose rows are dropped then.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.filings import FORMS, filing_event_type, filing_title, item_codes
from newsloom.functions.text import nonempty, parse_feed_time

NO_TICKERS = "array<string>"


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(NO_TICKERS)


def _no_filing() -> list[Column]:
    return [F.lit(None).cast("string").alias("sec_form_type"), F.lit(None).cast(NO_TICKERS).alias("sec_items"), F.lit(None).cast("string").alias("event_type_hint")]


def read_rss(spark: SparkSession, paths: str | list[str], source: str, as_of: datetime, ticker: str | None = None, publisher: str | None = None) -> DataFrame:
    """One row for each `item` with a title and a link."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(paths)
    at = F.coalesce(parse_feed_time(F.col("pubDate")), F.lit(as_of).cast("timestamp_ntz"))
    rows = items.select(
        F.lit(source).alias("source"), nonempty(F.col("title")).alias("title"), nonempty(F.col("link")).alias("url"), at.alias("published_at"), nonempty(F.col("description")).alias("summary_raw"),
        F.lit(publisher).cast("string").alias("publisher"), (_strings(ticker) if ticker else _strings()).alias("tickers"), *_no_filing(),
    )
    return rows.filter("title is not null and url is not null")


def read_news_json(spark: SparkSession, paths: str | list[str], source: str, as_of: datetime, ticker: str | None = None) -> DataFrame:
    """Arrays of news objects; tickers are the asked one, then the related ones."""
    items = spark.read.option("multiLine", True).schema("datetime long, headline string, related string, source string, summary string, url string").json(paths)
    at = F.when(F.coalesce("datetime", F.lit(0)) != 0, F.timestamp_seconds("datetime").cast("timestamp_ntz")).otherwise(F.lit(as_of).cast("timestamp_ntz"))
    related = F.filter(F.transform(F.split(F.coalesce("related", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = items.select(
        F.lit(source).alias("source"), nonempty(F.col("headline")).alias("title"), nonempty(F.col("url")).alias("url"), at.alias("published_at"), nonempty(F.col("summary")).alias("summary_raw"),
        nonempty(F.col("source")).alias("publisher"), F.array_distinct(F.concat(_strings(ticker) if ticker else _strings(), related)).alias("tickers"), *_no_filing(),
    )
    return rows.filter("title is not null and url is not null")


def cik_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik): upper-case tickers and ten-digit keys."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: string, ticker: string>>"))).alias("r"))
    return rows.select(F.upper("r.ticker").alias("ticker"), F.lpad("r.cik_str", 10, "0").alias("cik")).dropDuplicates(["ticker"])


SUBMISSIONS = "cik string, tickers array<string>, filings struct<recent: struct<accessionNumber: array<string>, filingDate: array<string>, form: array<string>, primaryDocument: array<string>, items: array<string>>>"


def read_filings(spark: SparkSession, paths: str | list[str], ciks: DataFrame, forms: Iterable[str] = tuple(FORMS), most: int = 10, source: str = "sec_edgar") -> DataFrame:
    """Filings of the listed forms, the first `most` of each ticker in document order (counted before a
    row with a bad date is dropped). A ticker without a key has none."""
    docs = spark.read.option("multiLine", True).schema(SUBMISSIONS).json(paths)
    r = F.col("filings.recent")
    zipped = F.arrays_zip(r["form"].alias("form"), r["filingDate"].alias("filingDate"), r["accessionNumber"].alias("accession"), r["primaryDocument"].alias("doc"), r["items"].alias("items"))
    rows = docs.select(F.upper(F.try_element_at("tickers", F.lit(1))).alias("ticker"), F.posexplode(zipped).alias("pos", "f")).select("ticker", "pos", "f.*")
    turn = F.row_number().over(Window.partitionBy("ticker").orderBy("pos"))
    first = rows.filter(F.col("form").isin(list(forms))).withColumn("turn", turn).filter(F.col("turn") <= most)
    known = first.join(ciks, "ticker")
    at = F.to_timestamp_ntz(F.try_to_date("filingDate", "yyyy-MM-dd").cast("string"))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"), F.regexp_replace(F.coalesce("accession", F.lit("")), "-", ""), F.lit("/"), F.coalesce("doc", F.lit("")))
    out = known.select(
        F.lit(source).alias("source"), filing_title(F.col("ticker"), F.col("form"), F.col("items")).alias("title"), url.alias("url"), at.alias("published_at"), F.lit(None).cast("string").alias("summary_raw"),
        F.lit("SEC EDGAR").alias("publisher"), F.array("ticker").alias("tickers"), F.col("form").alias("sec_form_type"), item_codes(F.col("items")).alias("sec_items"), filing_event_type(F.col("form"), F.col("items")).alias("event_type_hint"),
    )
    return out.filter("published_at is not null")


def load_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Golden cases, and rejects (id, problem): repeated article ids, or an injection case that expects nothing."""
    cases = spark.read.schema(schemas.GOLDEN).json(path)
    ids = F.transform("articles", lambda a: a["id"])
    problem = F.when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated article id").when((F.col("category") == "injection") & F.col("expected_quarantined").isNull() & F.col("expected_injection_suspected").isNull(), "no expectation")
    told = cases.withColumn("problem", problem)
    return told.filter("problem is null").drop("problem"), told.filter("problem is not null").select("id", "problem")
