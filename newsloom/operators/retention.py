"""Retention applied to stored tables: folders by day (or month), of which only those that lose rows are touched.

A period that loses all its rows is a folder deleted; one that loses some is written anew, alone; the files of all
other periods stay as they are. Children go before their parents, so that a run that breaks off leaves nothing that
points nowhere, and run again does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import remove_path, staged

PERIOD = "period"
#: The order in which tables lose rows.
ORDER = ["fact_evidence", "story_facts", "stories", "llm_calls", "articles"]


def write_by_period(rows: DataFrame, path: str, column: str, unit: str = "day") -> None:
    """Append rows to a stored table, a folder for each day (or month, or year) of `column`; rows without one have a folder too."""
    placed = rows.withColumn(PERIOD, F.date_trunc(unit, F.col(column)).cast("date"))
    placed.repartition(PERIOD).write.mode("append").partitionBy(PERIOD).parquet(path)


def delete_rows(spark: SparkSession, path: str, ids: DataFrame) -> dict[str, int]:
    """Delete the rows of a stored table that have one of `ids` (id); returns rows and periods deleted, and periods written anew."""
    table = spark.read.parquet(path)
    marked = table.select("id", PERIOD).join(ids.select("id").distinct().withColumn("gone", F.lit(1)), "id", "left")
    periods = marked.groupBy(PERIOD).agg(F.count("*").alias("rows"), F.count("gone").alias("gone")).filter("gone > 0").collect()  # a row for each period
    emptied = [r[PERIOD] for r in periods if r.rows == r.gone]
    thinned = [r[PERIOD] for r in periods if r.rows > r.gone]
    if thinned:
        some = F.col(PERIOD).isin([d for d in thinned if d is not None])
        some = F.coalesce(some, F.lit(False)) | F.col(PERIOD).isNull() if None in thinned else some
        # Written aside first: what is read is then overwritten.
        kept = staged(table.filter(some).join(ids.select("id"), "id", "left_anti"), "kept")
        kept.select(table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)
    for d in emptied:
        remove_path(spark, f"{path}/{PERIOD}={'__HIVE_DEFAULT_PARTITION__' if d is None else d.isoformat()}")
    return {"rows": sum(r.gone for r in periods), "periods_deleted": len(emptied), "periods_written": len(thinned)}


def apply_retention(spark: SparkSession, paths: dict[str, str], removed: dict[str, DataFrame]) -> dict[str, dict[str, int]]:
    """Delete what `health.retention` names from the stored tables at `paths`; what was done, by table."""
    ids = {name: staged(removed[name].select("id"), f"old-{name}") for name in ORDER if name in paths}  # before any table changes
    return {name: delete_rows(spark, paths[name], ids[name]) for name in ids}
