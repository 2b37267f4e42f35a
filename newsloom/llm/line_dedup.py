"""Line dedup: range-partitioned line hashes, streamed in order, keep bitmaps per document.

Lines are split at newline; a line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z
lower-cased. Keys of at least `min_points` code points that occur in two documents or more stay only
in the smallest doc_id that holds them, there in all their places.

1. Each input task names its lines by 128-bit hashes, FLUSH lines at a time. A key that these hold in a
   smaller document needs no further question: of each key the task sends on its smallest document's
   lines only, marked `asks`, and settles the others itself. So a line that every document holds reaches
   the shuffle once for each FLUSH lines, not once for each document.
2. The asking lines are range-partitioned by hash and sorted by hash, document and position; a stream
   over each partition keeps the first document of a key and marks the lines of the others. No group
   is held in memory.
3. Dropped positions meet per document in a compressed bitmap; texts move only to be written anew.

Defined cases: a null or empty text is one empty line; a null doc_id counts as larger than all others
and such rows count as one document; rows with equal doc_id are one document to each other; repeated
rows share one fate; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.bytegrid import IS_SPACE, Grid, blocks, ids, longs
from newsloom.llm.rows import numbered_schema, ordered_id, row_key, slim, unnumbered
from newsloom.session import staged

LINES = "k1 long, k2 long, doc long, row_key long, pos int, asks boolean"
DROPS = "doc long, row_key long, pos int"
#: Lines that a task holds before it settles what it can of them and sends them on. Any number gives the same result.
FLUSH = 1 << 19


def _stripped(grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each line without the spaces at both ends."""
    solid = ~IS_SPACE[grid.buf]
    at = np.arange(len(grid.buf), dtype=np.int64)
    before = np.maximum.accumulate(np.where(solid, at, -1))  # last solid byte up to here
    after = np.minimum.accumulate(np.where(solid, at, len(at))[::-1])[::-1]
    some = before[grid.le] >= grid.ls
    s = np.where(some, after[np.minimum(grid.ls, len(at) - 1)], grid.ls)
    e = np.where(some, before[grid.le] + 1, grid.ls)
    return s, e


def _name_lines(min_points: int, flush: int = FLUSH):
    def settled(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k1, k2, doc, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, k2, k1))
        k1, k2, doc, row, pos = k1[order], k2[order], doc[order], row[order], pos[order]
        first = np.ones(len(k1), bool)
        first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        least = doc[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(k1) else doc
        for i in range(0, len(k1), 50_000):
            j = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [longs(k1[j]), longs(k2[j]), longs(doc[j]), longs(row[j]), pa.array(pos[j]), pa.array(doc[j] == least[j])],
                ["k1", "k2", "doc", "row_key", "pos", "asks"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0
        for batch, texts in blocks(batches):
            grid = Grid(texts).lines()
            s, e = _stripped(grid)
            points = grid.points()
            use = np.flatnonzero(points[e] - points[s] >= min_points)
            pos = np.arange(len(grid.ls)) - grid.llo[grid.ldoc]
            parts.append([
                grid.hashes(s[use], e[use], 0, fold=True), grid.hashes(s[use], e[use], 1, fold=True),
                ids(batch)[grid.ldoc[use]], ids(batch, "row_key")[grid.ldoc[use]], pos[use].astype(np.int32),
            ])
            held += len(use)
            if held >= flush:
                yield from settled(parts)
                parts, held = [], 0
        if parts:
            yield from settled(parts)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and document, those that aren't of their key's first document."""
    last = None  # key and first document of the group that the previous batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, doc, row, pos = (batch.column(i).to_numpy() for i in range(5))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        held = last is not None and last[0] == k1[0] and last[1] == k2[0]
        new[0] = True
        heads = doc[new].copy()
        if held:
            heads[0] = last[2]
        keeper = heads[np.cumsum(new) - 1]
        last = (k1[-1], k2[-1], keeper[-1])
        out = doc != keeper
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(row[out]), pa.array(pos[out])], ["doc", "row_key", "pos"])


def dropped_lines(docs: DataFrame, min_points: int = 10) -> DataFrame:
    """(doc, row_key, pos): the lines that go; doc is NO_ID for a null doc_id."""
    lines = staged(slim(docs).mapInArrow(_name_lines(min_points), LINES), "lines")
    asking = lines.filter("asks").select("k1", "k2", "doc", "row_key", "pos")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = asking.repartitionByRange(n, "k1", "k2").sortWithinPartitions("k1", "k2", "doc", "pos")
    settled = lines.filter("not asks").select("doc", "row_key", "pos")
    return settled.unionByName(ranged.mapInArrow(_later, DROPS))


def _bitmap(pos: np.ndarray) -> bytes:
    """Keep bits by line, in whole bytes up to the last dropped one; lines beyond are kept. Deflated."""
    keep = np.ones(int(pos.max()) // 8 * 8 + 8, bool)
    keep[pos] = False
    return zlib.compress(np.packbits(keep).tobytes())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document -> one bitmap for each. Of a document that batches cut, its positions are held."""

    def out(docs: list[tuple[int, int]], positions: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in docs], pa.int64()), pa.array([r for _, r in docs], pa.int64()), pa.array([len(np.unique(p)) for p in positions], pa.int64()), pa.array([_bitmap(p) for p in positions], pa.binary())],
            ["doc", "row_key", "n_dropped", "bitmap"],
        )

    open_: tuple[int, int] | None = None
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, row, pos = (batch.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
        docs, positions = [], []
        for i, part in zip(cut.tolist(), np.split(pos, cut[1:]), strict=True):
            name = (int(doc[i]), int(row[i]))
            if open_ is not None and name != open_:
                docs.append(open_)
                positions.append(np.concatenate(held))
                held = []
            open_ = name
            held.append(part)
        if docs:
            yield out(docs, positions)
    if open_ is not None:
        yield out([open_], [np.concatenate(held)])


def keep_bitmaps(docs: DataFrame, min_points: int = 10) -> DataFrame:
    """(doc, row_key, n_dropped, bitmap) of each row that loses lines; bit i says whether line i stays."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lost = dropped_lines(docs, min_points).repartition(n, "doc", "row_key").sortWithinPartitions("doc", "row_key", "pos")
    return lost.mapInArrow(_bitmaps, "doc long, row_key long, n_dropped long, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, columns: list[Column]) -> DataFrame:
    """`columns` of each row of `docs`, and its `bitmap`, null where all lines stay. Texts move once, to the bitmaps, which are the hashed side."""
    marked = docs.select(ordered_id().alias("_doc"), row_key().alias("_row"), *columns)
    small = bitmaps.select(F.col("doc").alias("_doc"), F.col("row_key").alias("_row"), "bitmap").hint("shuffle_hash")
    return marked.join(small, ["_doc", "_row"], "left").drop("_doc", "_row")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, its lines before, and the dropped ones."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, maps = (batch.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))
        got = [kept_text(t or b"", m) for t, m in zip(texts, maps, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
             pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digest(docs: DataFrame, min_points: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    both = with_bitmaps(docs, keep_bitmaps(docs, min_points), [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])
    return both.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _cut(place: int):
    """Rows with their bitmap last -> the rows with their text, column `place`, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, maps = batch.columns
            text = columns[place]
            cut = [t if m is None or t is None else kept_text(t, m)[0] for t, m in zip(text.cast(pa.binary()).to_pylist(), maps.to_pylist(), strict=True)]
            columns[place] = pa.array(cut, pa.binary()).cast(text.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def dedup_lines(docs: DataFrame, min_points: int = 10) -> DataFrame:
    """`docs` with the dropped lines gone from text; other columns unchanged. A null text stays null.

    The columns must be of types that Arrow can carry.
    """
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    both = with_bitmaps(docs, keep_bitmaps(docs, min_points), named)
    return both.mapInArrow(_cut(docs.columns.index("text")), T.StructType(numbered_schema(docs))).select(*unnumbered(docs))
