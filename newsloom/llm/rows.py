"""What the operators expect of a table of documents, and how they name its rows.

Only doc_id, an integer (or a string of digits; anything else fails in Spark's cast), and text are needed; any other columns, whatever their names, are left out of the work and
come back unchanged where an operator returns whole documents. A row is named by (doc_id, hash of
text): repeated rows have one name and one fate, rows that share only the id are told apart. A null
doc_id counts as larger than every other id, so that such rows never count as the earlier copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.bytegrid import NO_ID
from newsloom.session import ship, staged

WORD = r"[^\x20\x09-\x0D]+"


def slim(docs: DataFrame) -> DataFrame:
    """The columns doc_id, row_key, text, under these names alone."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def whole(docs: DataFrame) -> Column:
    """The row as one struct, `whole`, apart from any names that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of `docs` under the names c0, c1, ..., which no operator's own columns clash with."""
    ship(docs.sparkSession)
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def numbered_schema(docs: DataFrame) -> list[T.StructField]:
    return [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]


def unnumbered(docs: DataFrame) -> list[Column]:
    """The columns of `docs` again, from their numbered names."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]


def small_side(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """`df`, a staged table of narrow rows, marked for broadcast if it is counted to be small.

    A larger one is left to a shuffled join, whose skew AQE splits.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ordered_id(name: str = "doc_id") -> Column:
    """doc_id as a sortable long, NO_ID where null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def shown_id(name: str = "doc_id") -> Column:
    """The inverse of ordered_id."""
    return F.nullif(F.col(name), F.lit(NO_ID))


def distinct_sample(rows: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """(by, text, turn, of), staged: at most `most` distinct texts of each value of `by` (few values), chosen by hash;
    `turn` is the text's number among them, from 1, and `of` how many they are.

    However often a text is repeated, it counts once: a hash threshold, from the number of distinct texts, passes about
    a quarter more than asked for, tasks drop the copies they hold, and the rest is cut by number. With an estimate that
    is too high fewer may come, never more.
    """
    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    named = rows.select(key.alias("by"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    counts = {r.by: r.n for r in named.groupBy("by").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        counts = {"": 1}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.25 * most / max(n, 1)))])[F.col("by")]
    place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    few = named.filter(place <= share).groupBy("by", "h").agg(F.min("text").alias("text"))
    group = Window.partitionBy("by")
    cut = few.withColumn("turn", F.row_number().over(group.orderBy("h"))).filter(F.col("turn") <= most)
    return staged(cut.withColumn("of", F.count("*").over(group)).select("by", "text", "turn", "of"), "sample")


def remainder(modulus: int) -> Column:
    """crc32 of the id's digits, modulo `modulus`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus
