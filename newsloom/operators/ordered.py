"""Numbers and running totals along a global order, without one task that holds it all.

Rows are dealt out by ranges of the order and written to the shared folder, so that the ranges stay as
they are; each range is counted or summed; the sums of the ranges before it, one small row for each range,
are joined back; windows run inside a range only. A range is cut anywhere between two different keys, so
the order should end in an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import staged

RANGE = "_range"


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """The rows with `_range`, rising along `order`; equal keys are in one range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _with_totals_before(rows: DataFrame, totals: dict[str, Column], within: list[str]) -> DataFrame:
    """Adds, for each name, the total over the earlier ranges of the same `within` group.

    The joined table has a row for each range and group that meet: as many as there are ranges, and one
    more for each group.
    """
    sums = rows.groupBy(*within, RANGE).agg(*[c.alias(name) for name, c in totals.items()])
    earlier = Window.partitionBy(*within).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, RANGE, *[F.sum(name).over(earlier).alias(name) for name in totals])
    return rows.join(sums, [*within, RANGE])


def numbered_along(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the row's number along `order`, from 1."""
    rows = _with_totals_before(ranged(df, order), {"_before": F.count("*")}, [])
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order)).cast("long")
    return rows.withColumn(name, inside + F.coalesce("_before", F.lit(0))).drop("_before", RANGE)


def running_total(rows: DataFrame, order: list[Column], value: Column, name: str, within: list[str]) -> DataFrame:
    """Adds the sum of `value` over the earlier rows of the same group; `rows` come from `ranged`, along within + order."""
    out = _with_totals_before(rows, {"_before": F.sum(value)}, within)
    before = Window.partitionBy(*within, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(out.schema["_before"].dataType)
    return out.withColumn(name, F.coalesce("_before", zero) + F.coalesce(F.sum(value).over(before), zero)).drop("_before")
