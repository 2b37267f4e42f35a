"""Connectors: what a run of ingest reads, one source each, and a run over all of them in which a failing one stops none.

A connector has a name, a kind and a function that makes rows of schemas.RAW_ARTICLES (without `arrival`) from a
session and the run's time. The readers of `readers` make the shipped ones; a new kind of source needs one function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.ids import key_id
from newsloom.session import staged
from newsloom.sources import readers

Fetch = Callable[[SparkSession, datetime], DataFrame]


@dataclass(frozen=True)
class Connector:
    name: str
    kind: str
    fetch: Fetch
    is_official: bool = False
    enabled: bool = True


def rss(name: str, paths: str | list[str], ticker: str | None = None, publisher: str | None = None, is_official: bool = False) -> Connector:
    return Connector(name, "rss", lambda spark, as_of: readers.read_rss(spark, paths, name, as_of, ticker, publisher), is_official)


def news_json(name: str, paths: str | list[str], ticker: str | None = None) -> Connector:
    return Connector(name, "api", lambda spark, as_of: readers.read_news_json(spark, paths, name, as_of, ticker))


def filings(name: str, paths: str | list[str], cik_paths: str, most: int = 10) -> Connector:
    return Connector(name, "primary", lambda spark, as_of: readers.read_filings(spark, paths, readers.cik_lookup(spark, cik_paths), most=most, source=name), True)


def source_table(spark: SparkSession, connectors: Iterable[Connector]) -> DataFrame:
    """The connectors as rows of schemas.SOURCES; ids follow from names."""
    rows = spark.createDataFrame([(c.name, c.kind, c.is_official, c.enabled) for c in connectors], "name string, kind string, is_official boolean, enabled boolean")
    return rows.select(key_id(F.lit("source"), F.col("name")).alias("id"), "name", "kind", "is_official", "enabled")


def fetched(spark: SparkSession, connectors: Iterable[Connector], as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows of all enabled connectors with `arrival`, errors (source, error)).

    Each connector's rows are written to the shared folder before the next is read: an error is that source's alone.
    Arrival follows the order of the connectors, and within one the order of its files.
    """
    found: list[DataFrame] = [spark.createDataFrame([], schemas.RAW_ARTICLES)]
    errors: list[tuple[str, str]] = []
    for turn, c in enumerate(x for x in connectors if x.enabled):
        try:
            rows = c.fetch(spark, as_of).withColumn("arrival", F.monotonically_increasing_id() + F.lit(turn) * F.lit(1 << 48))
            found.append(staged(rows.select(*found[0].columns), "fetched"))
        except Exception as e:  # whatever a source does, the others are read
            errors.append((c.name, f"{type(e).__name__}: {e}"))
    return reduce(DataFrame.unionByName, found), spark.createDataFrame(errors, "source string, error string")
