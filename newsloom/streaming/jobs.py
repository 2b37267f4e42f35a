"""Streaming forms of ingest and of the daily spending report."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom import schemas
from newsloom.functions.scan import RULES, Rule
from newsloom.functions.urls import canonical_url
from newsloom.session import ship
from newsloom.sources.ingest import prepared, upsert_articles

#: A landed row, with the time it landed at; rows without one are taken to have landed at the run's time.
LANDED = f"{schemas.RAW_ARTICLES}, landed_at timestamp_ntz"
_MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _first_writer(keep_ms: int):
    """Keeps, for each canonical URL, when its first row came; passes on that row and drops all others while the state lasts.

    It is given and returns as few columns as it can: a row is one text.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        met = [x for part in parts for x in zip(part["landed"].tolist(), part["arrival"].tolist(), part["row"].tolist(), strict=True)]  # one URL's rows of one batch
        first = min(met, key=lambda x: x[:2])
        if not state.exists:
            state.update((first[0] // 1000,))
            yield pd.DataFrame({"row": [first[2]]})
        state.setTimeoutTimestamp(max(max(x[0] for x in met) // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))

    return run


class _Held:
    """One URL's state among those of its bucket, with what `_first_writer` asks of a state."""

    hasTimedOut = False

    def __init__(self, watermark: int, value: tuple | None):
        self.watermark, self.value, self.exists, self.until = watermark, value, value is not None, 0

    def update(self, value: tuple) -> None:
        self.value, self.exists = value, True

    def setTimeoutTimestamp(self, at: int) -> None:
        self.until = at

    def getCurrentWatermarkMs(self) -> int:
        return self.watermark


def _first_writers(keep_ms: int):
    """`_first_writer` for each canonical URL of a bucket, whose states are held as one text: Spark calls Python once for a bucket, not for each URL.

    The bucket's timer is that of the URL that is due first; a URL whose time has passed is forgotten when the bucket is next called.
    """
    one = _first_writer(keep_ms)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}  # URL: when its first row came, and until when it is held
        now = state.getCurrentWatermarkMs()
        rows = pd.concat([pd.DataFrame({"url_key": [], "landed": [], "arrival": [], "row": []})] if state.hasTimedOut else list(parts))
        columns = {c: rows[c].to_numpy() for c in ("landed", "arrival", "row")}
        told, met = [], set()
        for url, at in rows.groupby("url_key", sort=False).indices.items():
            part = {c: x[at] for c, x in columns.items()}
            own = _Held(now, (held[url][0],) if url in held else None)
            told += [x for out in one((url,), iter([part]), own) for x in out["row"]]
            held[url] = [own.value[0], own.until]
            met.add(url)
        held = {url: x for url, x in held.items() if url in met or x[1] >= now}
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min(x[1] for x in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame({"row": told})

    return run


def stored_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles that streams (and batch jobs) have written to a folder, whatever its subfolders."""
    return spark.read.schema(schemas.ARTICLES).option("recursiveFileLookup", True).parquet(path)


def stream_ingest(
    spark: SparkSession, landing_dir: str, sources: DataFrame, articles_path: str, checkpoint: str, as_of: datetime, rules: list[Rule] = RULES, keep_ms: int = 7 * 86_400_000, delay: str = "7 days", files: int | None = None,
    buckets: int = 1024,
) -> StreamingQuery:
    """Landed JSON rows become articles, each canonical URL once; the first to land is the one.

    State by canonical URL drops repeats while it lasts: a timer in landing time removes it `keep_ms` after the URL was last
    met. What comes after that is held against the table, which a URL never leaves. A row that landed more than `delay`
    before the newest seen is late, and dropped, as in any stream with a watermark. A batch writes a folder of its own, and
    overwrites it when it is run again after a failure, not counting what it wrote before. `files`: files of one batch at most. `buckets`: URLs' states are kept in so many; for a
    checkpoint's whole life the same.
    """
    ship(spark)
    reader = spark.readStream.schema(LANDED)
    raw = (reader.option("maxFilesPerTrigger", files) if files else reader).json(landing_dir)
    at = F.coalesce("landed_at", F.lit(as_of).cast("timestamp_ntz"))
    valid = raw.filter("coalesce(title, '') <> '' and coalesce(url, '') <> ''").withColumns({"landed_at": at, "url_key": canonical_url(F.col("url"))})
    timed = valid.withColumn("event_time", F.col("landed_at").cast("timestamp")).withWatermark("event_time", delay)
    bucket = F.pmod(F.xxhash64("url_key"), F.lit(buckets)).alias("bucket")
    packed = timed.select(bucket, "url_key", "event_time", F.unix_micros("event_time").alias("landed"), F.coalesce("arrival", F.lit((1 << 63) - 1)).alias("arrival"), F.to_json(F.struct(*valid.columns), _MICROS).alias("row"))
    first = packed.groupBy("bucket").applyInPandasWithState(_first_writers(keep_ms), "row string", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    once = first.select(F.from_json("row", valid.schema, _MICROS).alias("row")).select("row.*")

    def append(batch: DataFrame, batch_id: int) -> None:
        own = f"batch={batch_id}"
        known = stored_articles(batch.sparkSession, articles_path).filter(~F.col("_metadata.file_path").contains(f"/{own}/"))
        rows = prepared(batch, sources, as_of, rules, fetched_at=F.col("landed_at"))
        upsert_articles(rows, known).write.mode("overwrite").parquet(f"{articles_path}/{own}")

    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_cost_by_day(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calls, cache hits and cost by tumbling day of a stream (or table) of ledger rows; for update mode. Rows later than `delay` are dropped."""
    timed = calls.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
    out = timed.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "cache_hit").alias("cache_hits"), F.sum("cost_usd").alias("cost_usd"))
    return out.select(F.col("w.start").cast("date").alias("day"), "calls", "cache_hits", "cost_usd")


def stream_cost_table(calls: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Keeps a table of days, one folder each: a batch replaces the days that it has changed, and no others.

    The rows of a batch are whole days' sums, so that a batch run again writes the same.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    days = stream_cost_by_day(calls, delay)
    return days.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
