"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

An item's features are its shingles of `size` words (A-Z lower-cased; an item of fewer words is one
shingle), weighted by how often they occur. A document window of as many words as an item is a leak if
the weighted Jaccard similarity of the two, sum of minima / sum of maxima, is at least `percent` / 100.
A document of fewer words than an item is one window as a whole.

1. Windows. A window without any of an item's shingles has similarity 0, so only windows around shared
   shingles are fingerprinted, all of them, at every offset and in every text as a whole.
2. Fingerprints. A window's 64-bit SimHash is the sign of the sum of its shingles' +1/-1 vectors, from
   prefix sums over the document.
3. Index. Fingerprints of items are cut into RADIUS + 1 blocks of bits; two fingerprints within RADIUS
   agree on one block at least, so looking a window's blocks up finds every item within the radius.
4. Candidates are verified exactly on the shingles' counts.

At similarity 0.75 two SimHashes differ in 11 bits on average; the default radius of 24 is more than
four standard deviations above, and candidates are few after step 1, so the radius is chosen for recall.

The benchmark is a query set: it is read in blocks of at most `block_items` items and BLOCK_WORDS words,
each block broadcast by its checked size and held against all documents; a larger benchmark makes more
passes, never a larger broadcast. The fingerprints of documents never leave their task.

Defined cases: null or empty texts and items have no words and match nothing; a null doc_id or item_id
comes back as null; repeated rows are reported once each; of windows that tie in similarity the first
counts; an empty table of either kind gives an empty result; extra columns are ignored or come back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.bytegrid import Grid, blocks, mix, span_sums, window_hashes
from newsloom.llm.rows import whole
from newsloom.session import ship

RADIUS = 24
BLOCK_WORDS = 2_000_000
#: Most windows whose sign vectors are summed at once.
STRETCH = 1 << 14


def _block_edges(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of the radius + 1 blocks of a 64-bit fingerprint."""
    cuts = np.linspace(0, 64, radius + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def signs(s: np.ndarray) -> np.ndarray:
    """The +1/-1 vectors of shingles, one row each."""
    bits = np.unpackbits(mix(s, 31).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHashes of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def similarity(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    common = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - common
    return common / total if total else 0.0


def shingles(grid: Grid, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word names, and the name of the shingle from each word on (rows aren't told apart here)."""
    h = grid.hashes(grid.ws, grid.we, 0, fold=True)
    return h, window_hashes(h, size)


def _bag(h: np.ndarray, size: int) -> np.ndarray:
    """Shingles of a run of words."""
    if len(h) >= size:
        return window_hashes(h, size)
    return short_name(h, np.zeros(1, np.int64), len(h)) if len(h) else h


def short_name(h: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    return mix(span_sums(h, starts, starts + words, 4) + np.uint64(words), 40)


class Items:
    """A block of the benchmark: shingles, fingerprints and their multi-index, by window length."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, radius: int):
        self.size, self.radius = size, radius
        self.ids, bags, lengths = [], [], []
        for item, text in items:
            grid = Grid([(text or "").encode()]).words()
            h = grid.hashes(grid.ws, grid.we, 0, fold=True)
            if len(h):
                self.ids.append(item)
                bags.append(_bag(h, size))
                lengths.append(len(h))
        self.bags = [Counter(b.tolist()) for b in bags]
        self.lengths = np.array(lengths, np.int64)
        # Which items hold a shingle.
        flat = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags]) if bags else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owners = flat[order], owner[order]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.shingles >> np.uint64(46)] = True
        self.prints = np.array([fingerprint(signs(b).sum(axis=0, keepdims=True))[0] for b in bags], np.uint64) if bags else np.zeros(0, np.uint64)
        self.index: dict[tuple[int, int, int], list[int]] = {}
        for i, (n, p) in enumerate(zip(lengths, self.prints.tolist(), strict=True)):
            for k, (shift, bits) in enumerate(_block_edges(radius)):
                self.index.setdefault((n, k, p >> shift & ((1 << bits) - 1)), []).append(i)

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Places in s that hold an item's shingle."""
        if not len(self.shingles):
            return np.zeros(0, np.int64)
        some = np.flatnonzero(self.maybe[s >> np.uint64(46)])
        at = np.minimum(np.searchsorted(self.shingles, s[some]), len(self.shingles) - 1)
        return some[self.shingles[at] == s[some]]

    def holders(self, shingle: np.ndarray) -> set[int]:
        """The items that hold one of these shingles."""
        a, b = np.searchsorted(self.shingles, shingle), np.searchsorted(self.shingles, shingle, "right")
        return {int(i) for x, y in zip(a, b, strict=True) for i in self.owners[x:y]}

    def near(self, length: int, p: int) -> set[int]:
        """Items of `length` words whose fingerprint is within the radius of p."""
        found: set[int] = set()
        for k, (shift, bits) in enumerate(_block_edges(self.radius)):
            found.update(self.index.get((length, k, p >> shift & ((1 << bits) - 1)), ()))
        return {i for i in found if (int(self.prints[i]) ^ p).bit_count() <= self.radius}


def _near_hits(at: np.ndarray, before: int, last: int) -> np.ndarray:
    """Sorted places from `before` ahead of each place in `at` up to it, from 0 to `last`."""
    step = np.zeros(last + 2, np.int32)
    np.add.at(step, np.clip(at - before, 0, last + 1), 1)
    np.add.at(step, np.clip(at + 1, 0, last + 1), -1)
    return np.flatnonzero(np.cumsum(step)[: last + 1] > 0)


def leaks(h: np.ndarray, s: np.ndarray, at: np.ndarray, items: Items, percent: int) -> list[tuple[int, float, int, int, int]]:
    """(item, similarity, first word, end word, Hamming distance) of one document's best window for each item it holds.

    h: the document's words; s: its shingles; at: where items' shingles start in it.
    """
    size, out = items.size, {}
    holders = items.holders(np.unique(s[at])) if len(at) else set()
    for n in sorted({int(items.lengths[i]) for i in holders if items.lengths[i] >= size}):
        words = min(n, len(h))  # a shorter document is one window
        if 100 * (words - size + 1) < percent * (n - size + 1) - 1e-9:
            continue  # too few shingles to be like the item
        starts = _near_hits(at, words - size, len(h) - words)
        # Prefix sums of the sign vectors, over each stretch of neighbouring windows, long ones in parts.
        cuts = np.union1d(np.flatnonzero(np.diff(starts) > 1) + 1, np.arange(STRETCH, len(starts), STRETCH))
        for run in np.split(starts, cuts.astype(np.int64)):
            if not len(run):
                continue
            lo, hi = int(run[0]), int(run[-1]) + words - size + 1
            sums = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(signs(s[lo:hi]), axis=0, out=sums[1:])
            prints = fingerprint(sums[words - size + 1 :] - sums[: -(words - size + 1)])
            for w, p in zip(run.tolist(), prints.tolist(), strict=True):
                near = items.near(n, p) & holders
                if near:
                    bag = Counter(s[w : w + words - size + 1].tolist())
                    for i in near:
                        got = similarity(bag, items.bags[i])
                        if 100 * got >= percent - 1e-9 and got > out.get(i, (0.0,))[0]:
                            out[i] = (got, w, w + words, (int(items.prints[i]) ^ p).bit_count())
    return [(i, *x) for i, x in sorted(out.items())]


def _short_leaks(h: np.ndarray, items: Items) -> list[tuple[int, float, int, int, int]]:
    """Items of fewer words than a shingle: a window is like one only if it is the same, so never in a shorter document."""
    out = []
    for n in sorted({int(x) for x in items.lengths if x < items.size}):
        if n <= len(h):
            names = short_name(h, np.arange(len(h) - n + 1), n)
            for i in np.flatnonzero(items.lengths == n).tolist():
                same = np.flatnonzero(names == np.uint64(next(iter(items.bags[i]))))
                if len(same):
                    out.append((i, 1.0, int(same[0]), int(same[0]) + n, 0))
    return out


def _scan(items: Items, percent: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has_short = bool((items.lengths < items.size).any())
        for batch, texts in blocks(batches):
            grid = Grid(texts).words()
            h, s = shingles(grid, items.size)
            hits = items.hits(s)
            of = grid.wdoc[hits] if len(grid.wdoc) else hits
            inside = hits + items.size <= grid.whi[of]
            hits, of = hits[inside], of[inside]
            rows = []
            for d in range(grid.n) if has_short else np.unique(of).tolist():
                lo, hi = int(grid.wlo[d]), int(grid.whi[d])
                a, b = np.searchsorted(hits, [lo, hi])
                own = leaks(h[lo:hi], s[lo : max(lo, hi - items.size + 1)], hits[a:b] - lo, items, percent) if b > a else []
                if has_short:
                    own += _short_leaks(h[lo:hi], items)
                rows += [(d, *x) for x in own]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)).take(take) for c in keep),
                 pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()),
                 *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5))],
                [*keep, "item_id", "similarity", "word_start", "word_end", "hamming"],
            )

    return run


def item_blocks(benchmark: DataFrame, block_items: int = 20_000) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark's items in blocks of a bounded number of items and words."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator(prefetchPartitions=False)
    block, words = [], 0
    for r in rows:
        n = len(r.text.split()) if r.text else 0
        if block and (len(block) >= block_items or words + n > BLOCK_WORDS):
            yield block
            block, words = [], 0
        block.append((r.item_id, r.text))
        words += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 75, radius: int = RADIUS, block_items: int = 20_000) -> DataFrame:
    """doc_id, item_id, similarity, word_start, word_end, hamming: the best window of each row for each item it holds."""
    ship(docs.sparkSession)
    schema = "doc_id long, item_id long, similarity double, word_start long, word_end long, hamming long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_items):
        out = out.unionByName(rows.mapInArrow(_scan(Items(block, size, radius), percent, ["doc_id"]), schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 75, radius: int = RADIUS, block_items: int = 20_000) -> DataFrame:
    """The rows of `docs` without a leak, with their columns."""
    ship(docs.sparkSession)
    out = docs.select(whole(docs))
    for block in item_blocks(benchmark, block_items):
        out = out.filter(~_leaking(Items(block, size, radius), percent)(F.col("whole.text").cast("string")))
    return out.select("whole.*")


def _leaking(items: Items, percent: int):
    scan = _scan(items, percent, ["at"])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            found = np.zeros(len(text), bool)
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], ["at", "text"])
            for rows in scan(iter([batch])):
                found[rows.column(0).to_numpy()] = True
            yield pa.array(found)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.BooleanType())
