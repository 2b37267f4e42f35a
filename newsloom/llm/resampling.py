"""Importance resampling towards a target's n-grams, with segment deduplication.

Newlines part words, so a text's features (runs of one and of two consecutive words) are those of its
lines, and the pairs of words that a line end parts.

1. Lines of all texts are counted: a distinct line is one row with its occurrences. Its features, hashed to
   buckets, are found once, and kept beside it.
2. A document keeps the names of its lines, each with its occurrences, and the buckets of its pairs across lines.
3. Bucket counts of a corpus: each distinct line's, times its occurrences, and the pairs across lines.
4. A bucket's gain is the logarithm of its smoothed share in the target over that in the source. A line's
   gains are summed once; documents get the sums by the names of their lines, which Spark joins, and may split
   where one line is in a third of all documents.
5. A document's score is its mean gain, floored, and Gumbel noise drawn from its id. The highest scores of
   documents that have `least_words` are drawn, numbered along the order without one task for all of it.

The driver holds the bucket counts (`buckets` numbers a corpus) and the gains, whatever the corpus's size.

Defined cases: a null or empty text has no feature, weight 0 and isn't drawn; a null doc_id draws its noise
as an empty id and comes last among equal scores; repeated rows are documents of their own, with one
score; rows equal in score and id are numbered in any order; an empty table gives an empty result, an
empty target a gain from its smoothing alone; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bytegrid import LOWER, TERM_GAP, Grid, blocks, crc32_spans, longs
from newsloom.llm.rows import ordered_id, shown_id
from newsloom.operators.ordered import numbered_along
from newsloom.session import ship, staged

LINES = "k1 long, k2 long, n long, features binary, times long"
TEXTS = "row long, doc_id long, k1 array<long>, k2 array<long>, times array<long>, across binary"


def _packed(counts: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Runs of 16-bit values as a binary column."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 2
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat.astype(np.uint16)))]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    """All values of a binary column of 16-bit values, in row order."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16)


def _word_buckets(grid: Grid, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, buckets of each word with its successor, and whether both are of one row."""
    low = LOWER[grid.buf]
    one = crc32_spans(low, grid.ws, grid.we)
    space = np.full(1, 0x20, np.uint8)
    first = crc32_spans(space, np.zeros(max(0, len(one) - 1), np.int64), np.ones(max(0, len(one) - 1), np.int64), one[:-1])
    two = crc32_spans(low, grid.ws[1:], grid.we[1:], first)
    return one % buckets, two % buckets, grid.wdoc[1:] == grid.wdoc[:-1]


def _line_features(buckets: int):
    """(line, times) -> LINES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text="line"):
            grid = Grid(texts).words(TERM_GAP)
            one, two, same = _word_buckets(grid, buckets)
            n = np.maximum(2 * (grid.whi - grid.wlo) - 1, 0)
            at = np.concatenate([[0], np.cumsum(n)])[:-1][grid.wdoc] + 2 * (np.arange(len(grid.ws)) - grid.wlo[grid.wdoc])
            flat = np.zeros(int(n.sum()), np.int64)
            flat[at] = one
            flat[at[:-1][same] + 1] = two[same]
            yield pa.RecordBatch.from_arrays([longs(grid.hashes(grid.start, grid.end, 0)), longs(grid.hashes(grid.start, grid.end, 1)), pa.array(n, pa.int64()), _packed(n, flat), batch.column(batch.schema.get_field_index("times"))], ["k1", "k2", "n", "features", "times"])

    return run


def _text_lines(buckets: int):
    """(row, doc_id, text) -> TEXTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            grid = Grid(texts).words(TERM_GAP).lines()
            _, two, same = _word_buckets(grid, buckets)
            line = np.searchsorted(grid.le, grid.ws)  # of each word
            cross = np.flatnonzero(same & (line[1:] != line[:-1]))
            held = np.unique(line)  # lines with a word
            k1, k2 = (grid.hashes(grid.ls[held], grid.le[held], seed) for seed in (0, 1))
            doc = grid.ldoc[held]
            order = np.lexsort((k2, k1, doc))
            doc, k1, k2 = doc[order], k1[order], k2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(doc)))
            ends = pa.array(np.concatenate([[0], np.cumsum(grid.per_doc(doc[first]))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (longs(k1[first]), longs(k2[first]), pa.array(times, pa.int64()))]
            across = _packed(grid.per_doc(grid.wdoc[cross]), two[cross])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, across], ["row", "doc_id", "k1", "k2", "times", "across"])

    return run


def segments(texts: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (k1, k2, n, features, times) and texts (row, doc_id, k1, k2, times, across) of (doc_id, text), both staged."""
    ship(texts.sparkSession)
    lines = texts.filter("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    counted = lines.groupBy("line").agg(F.count("*").alias("times"))
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return staged(counted.mapInArrow(_line_features(buckets), LINES), "segments"), staged(numbered.mapInArrow(_text_lines(buckets), TEXTS), "texts")


def _counts(buckets: int):
    """(features, times) -> (bucket, n): a task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            sizes = np.array([len(x) // 2 for x in batch.column(0).to_pylist()], np.int64)
            np.add.at(total, _unpacked(batch.column(0)), np.repeat(batch.column(1).to_numpy(), sizes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(lines: DataFrame, texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket's features occur in a corpus."""
    rows = lines.select("features", "times").unionByName(texts.select(F.col("across").alias("features"), F.lit(1).cast("long").alias("times")))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.mapInArrow(_counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, both smoothed by one in each bucket."""
    k, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + k)) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _gains(gains: np.ndarray):
    """(..., packed features last) -> (..., n, gain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, packed = batch.columns
            sizes = np.array([len(x) // 2 for x in packed.to_pylist()], np.int64)
            upto = np.concatenate([[0], np.cumsum(gains[_unpacked(packed)])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes), pa.array(upto[ends] - upto[ends - sizes])], [*batch.schema.names[:-1], "n", "gain"])

    return run


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of each row."""
    slim = lambda df, key: df.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines, texts = segments(slim(docs, "doc_id"), buckets)
    gains = bucket_gains(bucket_counts(lines, texts, buckets), bucket_counts(*segments(slim(target, target.columns[0]), buckets), buckets))

    of_line = lines.select("k1", "k2", "features").mapInArrow(_gains(gains), "k1 long, k2 long, n long, gain long")
    across = texts.select("row", "doc_id", "across").mapInArrow(_gains(gains), "row long, doc_id long, n long, gain long")
    held = texts.select("row", F.explode(F.arrays_zip("k1", "k2", "times")).alias("x")).select("row", "x.*")
    inside = held.join(of_line, ["k1", "k2"]).select("row", F.lit(None).cast("long").alias("doc_id"), (F.col("times") * F.col("n")).alias("n"), (F.col("times") * F.col("gain")).alias("gain"))
    summed = across.unionByName(inside).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_features"), F.sum("gain").alias("gain"))

    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = summed.select(ordered_id().alias("doc_id"), "n_features", weight.alias("weight"), (weight + noise).alias("score"), ((F.col("n_features") + 1) / 2 < least_words).alias("short"))
    ranked = numbered_along(scored, [F.col("short"), F.col("score").desc(), F.col("doc_id")], "place")
    drawn = ranked.select(F.count_if(~F.col("short"))).first()[0] * percent // 100
    return ranked.select(shown_id().alias("doc_id"), "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
