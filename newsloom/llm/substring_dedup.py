"""Substring dedup by recompression.

A window is `width` consecutive words of one document. A window is a repeat if the same words also
start in a document with a smaller doc_id; every word that a repeat covers goes.

Recompression names a text's content bottom-up in rounds. The first round names maximal runs of one
word (name = hash of the word and the run's length); each later round gives every name a pseudo-random
side by its hash, and names each adjacent pair (left side, right side) anew (name = hash of the pair).
Names are 64-bit functions of content, so a round names the same pair alike in every document, on every
executor, without a dictionary that the cluster would have to agree on. Whether two names merge depends
on these two alone, so a symbol depends on a known stretch of words around it: its `context`. Equal
substrings therefore hold equal symbols wherever the context lies inside them.

1. Every window picks one symbol whose context lies inside it, of the highest round that has one (round
   0, single words, always has one), the smallest by hash. Equal windows pick equal symbols, whatever
   surrounds them. A document sends on the picked symbols, keyed by the words of their contexts: one for
   about seventeen words. A further symbol names the whole document, when it has `width` words or more.
2. Symbols that only one document holds are dropped: no window that picked them has a copy. Documents
   that share their whole-document symbol with a smaller doc_id are done: all their words go.
3. The rest of the documents that hold shared symbols are parsed again, and the windows that picked a
   shared symbol are verified: their 128-bit names, sorted by name and document, are streamed, and each
   window after its first document is a repeat.
4. Repeats meet their documents, cover their words, and the kept words are joined.

Texts move once, dealt out by row. Nothing is collected per group.

Defined cases: a null or empty text has no words; a null doc_id counts as larger than all others and
such rows count as one document; rows with equal doc_id never make each other's windows repeats;
repeated rows share one fate and both stay in the result; documents shorter than `width` words lose
nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bytegrid import NO_ID, Grid, blocks, covered, ids, inside, longs, mix, span_sums, window_hashes
from newsloom.llm.rows import shown_id, slim
from newsloom.session import staged

#: Pair rounds after the round of runs. With 4, a context has about 18 words.
ROUNDS = 4
FAR = 1 << 40


def parse(h: np.ndarray, wlo: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbol, context start, context end) of each round, in word positions.

    A context that reaches over a document's edge is FAR wide: nothing contains it.
    """
    n = len(h)
    sym, begin = h, np.arange(n + 1)
    edge = np.zeros(n + 1, bool)
    edge[wlo[wlo < n]] = True
    edge[n] = True
    lo, hi = begin, begin  # between words there is a break, whatever is around
    out = [(sym, lo[:-1], hi[1:])]
    for r in range(rounds + 1):
        if not len(sym):
            return [*out, *[out[-1]] * (rounds + 1 - r)]
        inner = ~edge[1:-1]
        if r == 0:
            joins = (sym[:-1] == sym[1:]) & inner
        else:
            right = (mix(sym, r) & np.uint64(1)).astype(bool)
            joins = ~right[:-1] & right[1:] & inner
        stay = np.concatenate([[True], ~joins])  # symbol i starts a new symbol
        first = np.flatnonzero(stay)
        size = np.diff(np.concatenate([first, [len(sym)]]))
        grown = size > 1
        new = sym[first]
        if r == 0:
            new = np.where(grown, mix(new + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 100), new)
        elif grown.any():
            new[grown] = mix(sym[first[grown]] * np.uint64(0x9FB21C651E98DF25) + sym[first[grown] + 1], 100 + r)
        # A break that stays depends on both symbols beside it, and so on the breaks at their other ends.
        left, right_end = np.concatenate([[0], np.arange(len(sym))]), np.concatenate([np.arange(1, len(sym) + 1), [len(sym)]])
        keep = np.concatenate([first, [len(sym)]])
        fixed = edge[keep]
        # At a document's edge it stays in any case; inside another document it might not.
        begin = begin[keep]
        lo, hi = np.where(fixed, begin - FAR, lo[left[keep]]), np.where(fixed, begin + FAR, hi[right_end[keep]])
        edge, sym = fixed, new
        out.append((sym, lo[:-1], hi[1:]))
    return out


def _picks(symbols: tuple[np.ndarray, np.ndarray, np.ndarray], windows: np.ndarray, n_words: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: the smallest symbol whose context it contains, or -1. Also the contexts."""
    sym, a, b = symbols
    fit = b - a <= width
    sym, a, b = sym[fit], a[fit], b[fit]
    if not len(sym) or not len(windows):
        return np.full(len(windows), -1), a, b
    below_a = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n_words + 1))])
    upto_b = np.cumsum(np.bincount(b, minlength=n_words + 1))
    lo, hi = below_a[windows], upto_b[windows + width]
    some = hi > lo
    # A sparse table of minima: level k holds the smallest of 2**k neighbours.
    level, span = [np.arange(len(sym))], 1
    most = int((hi - lo).max(initial=1))
    while 2 * span <= most:
        prev = level[-1]
        x, y = prev[:-span], prev[span:]
        level.append(np.where(sym[y] < sym[x], y, x))
        span *= 2
    out = np.full(len(windows), -1)
    k = np.zeros(len(windows), np.int8)
    k[some] = np.log2(hi[some] - lo[some]).astype(np.int8)
    for j, best in enumerate(level):
        w = np.flatnonzero(some & (k == j))
        x, y = best[lo[w]], best[hi[w] - (1 << j)]
        out[w] = np.where(sym[y] < sym[x], y, x)
    return out, a, b


def anchors(h: np.ndarray, wlo: np.ndarray, whi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, and the key of the symbol that each window picks."""
    n = len(h)
    starts = np.flatnonzero(inside(wlo, whi, n, width))
    key = np.zeros(len(starts), np.uint64)
    open_ = np.arange(len(starts))
    levels = parse(h, wlo)
    for r in range(len(levels) - 1, -1, -1):
        if not len(open_):
            break
        pick, a, b = _picks(levels[r], starts[open_], n, width)
        found = pick >= 0
        chosen, back = np.unique(pick[found], return_inverse=True)
        names = mix(span_sums(h, a[chosen], b[chosen], 3) + (b - a)[chosen].astype(np.uint64), 200 + r)
        key[open_[found]] = names[back]
        open_ = open_[~found]
    return starts, key


def _whole_key(h: np.ndarray, wlo: np.ndarray, whi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` words or more, and the name of all their words."""
    long = np.flatnonzero(whi - wlo >= width)
    return long, mix(span_sums(h, wlo[long], whi[long], 3) + (whi - wlo)[long].astype(np.uint64), 300)


def _name_symbols(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            grid = Grid(texts).words()
            doc, row = ids(batch), ids(batch, "row_key")
            h = grid.hashes(grid.ws, grid.we)
            starts, key = anchors(h, grid.wlo, grid.whi, width)
            turn = np.ones(len(key), bool)
            of = grid.wdoc[starts]
            turn[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            of, key = of[turn], key[turn]
            _, once = np.unique(mix(of.astype(np.uint64), 7) ^ key, return_index=True)
            long, whole = _whole_key(h, grid.wlo, grid.whi, width)
            d, k = np.concatenate([of[once], long]), np.concatenate([key[once], whole])
            is_whole = np.arange(len(d)) >= len(once)
            yield pa.RecordBatch.from_arrays([longs(k), pa.array(doc[d]), pa.array(row[d]), pa.array(is_whole)], ["key", "doc", "row_key", "whole"])

    return run


def _windows(width: int):
    """Verify: 128-bit names of the windows that picked one of the row's shared symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            grid = Grid(texts).words()
            doc, row = ids(batch), ids(batch, "row_key")
            shared = batch.column(batch.schema.get_field_index("keys"))
            h = grid.hashes(grid.ws, grid.we)
            starts, key = anchors(h, grid.wlo, grid.whi, width)
            of = grid.wdoc[starts]
            sizes = np.diff(shared.offsets.to_numpy())
            there = mix(np.repeat(np.arange(grid.n), sizes).astype(np.uint64), 7) ^ shared.flatten().to_numpy().view(np.uint64)
            ask = np.isin(mix(of.astype(np.uint64), 7) ^ key, there)
            at = starts[ask]
            w1, w2 = window_hashes(h, width, 11)[at], window_hashes(mix(h, 9), width, 12)[at]
            of = of[ask]
            # A document asks once about a window that it holds in many places.
            order = np.lexsort((w2, w1, of))
            first = np.ones(len(order), bool)
            x, y, z = w1[order], w2[order], of[order]
            first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
            x, y, z = x[first], y[first], z[first]
            for i in range(0, len(x), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([longs(x[j]), longs(y[j]), pa.array(doc[z[j]]), pa.array(row[z[j]])], ["w1", "w2", "doc", "row_key"])

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by window and document, those after the window's first document."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        w1, w2, doc, row = (batch.column(i).to_numpy() for i in range(4))
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        heads = doc[new].copy()
        if last is not None and last[0] == w1[0] and last[1] == w2[0]:
            heads[0] = last[2]
        keeper = heads[np.cumsum(new) - 1]
        last = (w1[-1], w2[-1], keeper[-1])
        out = doc != keeper
        yield pa.RecordBatch.from_arrays([pa.array(w1[out]), pa.array(doc[out]), pa.array(row[out])], ["w1", "doc", "row_key"])


def _sha(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def kept_words(grid: Grid, gone: np.ndarray) -> list[bytes]:
    """Each row's words that aren't `gone`, joined by one space."""
    buf = grid.buf.copy()
    buf[grid.we] = 32  # the byte after a word; each row ends in one
    take = np.zeros(len(buf) + 1, np.int8)
    take[grid.ws[~gone]] += 1
    take[grid.we[~gone] + 1] -= 1
    on = np.cumsum(take, dtype=np.int8)[:-1].astype(bool)
    upto = np.concatenate([[0], np.cumsum(on)])
    out = buf[on].tobytes()
    a, b = upto[grid.start].tolist(), upto[grid.end + 1].tolist()
    return [out[x : y - 1] if y > x else b"" for x, y in zip(a, b, strict=True)]


def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        grid = Grid(texts).words()
        kept = kept_words(grid, np.zeros(len(grid.ws), bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids(batch)), batch.column(batch.schema.get_field_index("row_key")), pa.array(grid.whi - grid.wlo), pa.array([_sha(k) for k in kept])],
            ["doc", "row_key", "n_words", "kept_sha256"],
        )


def _cut(width: int):
    """Cover the words of each row's repeats; `gone` holds their first names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            grid = Grid(texts).words()
            repeats = batch.column(batch.schema.get_field_index("gone"))
            h = grid.hashes(grid.ws, grid.we)
            n = len(h)
            w = window_hashes(h, width, 11)
            ok = np.flatnonzero(inside(grid.wlo, grid.whi, n, width))
            sizes = np.diff(repeats.offsets.to_numpy())
            there = mix(np.repeat(np.arange(grid.n), sizes).astype(np.uint64), 7) ^ repeats.flatten().to_numpy().view(np.uint64)
            hit = ok[np.isin(mix(grid.wdoc[ok].astype(np.uint64), 7) ^ w[ok], there)]
            lost = covered(hit, width, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids(batch)), batch.column(batch.schema.get_field_index("row_key")), pa.array(grid.per_doc(grid.wdoc[lost])), pa.array(kept_words(grid, lost), pa.binary())],
                ["doc", "row_key", "n_removed", "kept"],
            )

    return run


def _stage_repeats(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are whole copies (doc, row_key), and the cut texts of those that lose other words."""
    rows = slim(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    symbols = staged(rows.mapInArrow(_name_symbols(width), "key long, doc long, row_key long, whole boolean"), "symbols")
    shared = symbols.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    held = staged(symbols.join(shared.select("key", "least"), "key").select("key", "doc", "row_key", "whole", "least"), "shared")
    copies = held.filter("whole and doc > least").select("doc", "row_key").distinct()
    asked = held.filter("not whole").groupBy("doc", "row_key").agg(F.collect_set("key").alias("keys"))
    asked = asked.join(copies, ["doc", "row_key"], "left_anti").select(F.col("doc").alias("doc_id"), "row_key", "keys")
    # Texts are dealt out by row once: this join and the one with `gone` read the same exchange.
    windows = rows.join(asked.hint("shuffle_hash"), ["doc_id", "row_key"]).mapInArrow(_windows(width), "w1 long, w2 long, doc long, row_key long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = windows.repartition(n, "w1").sortWithinPartitions("w1", "w2", "doc")
    repeats = ranged.mapInArrow(_repeats, "w1 long, doc long, row_key long")
    gone = repeats.groupBy(F.col("doc").alias("doc_id"), "row_key").agg(F.collect_list("w1").alias("gone"))
    cut = rows.join(gone.hint("shuffle_hash"), ["doc_id", "row_key"]).mapInArrow(_cut(width), "doc long, row_key long, n_removed long, kept binary")
    return copies, cut


def substring_digest(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    copies, cut = _stage_repeats(docs, width)
    rows = slim(docs).mapInArrow(_untouched, "doc long, row_key long, n_words long, kept_sha256 string")
    lost = cut.select("doc", "row_key", F.col("n_removed").alias("n"), F.sha2("kept", 256).alias("sha"))
    lost = lost.unionByName(copies.select("doc", "row_key", F.lit(-1).cast("long").alias("n"), F.sha2(F.lit(""), 256).alias("sha")))
    both = rows.join(lost.dropDuplicates(["doc", "row_key"]), ["doc", "row_key"], "left")
    removed = F.when(F.col("n") < 0, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0)))
    return both.select(shown_id("doc").alias("doc_id"), "n_words", removed.alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


def dedup_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, text): each row's text without repeated passages; rows that lose nothing keep their text as it is."""
    copies, cut = _stage_repeats(docs, width)
    lost = cut.select("doc", "row_key", F.col("kept").cast("string").alias("kept"))
    lost = lost.unionByName(copies.select("doc", "row_key", F.lit("").alias("kept")))
    rows = slim(docs).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    return rows.join(lost.dropDuplicates(["doc", "row_key"]), ["doc", "row_key"], "left").select("doc_id", F.coalesce("kept", "text").alias("text"))
