"""Ranked lexical search, reversed: documents stream through an index of the items.

1. Each item's terms are named by 128-bit hashes. Items are cut to blocks of at most `block_terms` terms
   and one item; each block in turn is made an inverted index (term -> items) and broadcast, its size bound so.
2. One pass over the documents counts, for the block's terms, the documents that hold each; and all
   documents and terms.
3. A second pass counts each document's terms, looks them up in the index, and adds each term's share to the
   scores of the items that hold it. A task keeps the `most` best documents of each item (a heap of
   fixed size, refilled in bulk), and nothing else.
4. The heaps of all tasks are merged by item.

Work grows with documents times the items that their terms meet; what a task holds doesn't grow with the
documents. A document's text is read whole; no document is passed over. Scores are 64-bit integers, exact
while 90 * (a document's terms) * (documents) stays below 2**63.

Defined cases: a null text, or one without terms, is no document and an item without results; rows that
share an item_id (null included) are one item with the terms of all of them; repeated document rows are
documents of their own; a null doc_id comes after all others at equal scores; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bytegrid import NO_ID, TERM_GAP, Grid, blocks, ids, longs
from newsloom.llm.rows import ordered_id, shown_id
from newsloom.operators.ordered import ranged, running_total
from newsloom.session import ship, staged

#: Shares and scores that a task holds at once, whatever the blocks' sizes; any number gives the same result.
HELD = 1 << 20
#: Rows of the counting pass that are no term's: documents, and their terms.
DOCUMENTS, TERMS = -1, -2


@dataclass
class Index:
    """Terms by their names, rising; term t is held by items[starts[t]:starts[t + 1]]."""

    k1: np.ndarray
    k2: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    n_items: int


@dataclass
class Weights:
    """Of a block's terms, and what a document's length counts against."""

    term: np.ndarray
    documents: int
    terms: int


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> a row for each term of each row."""
    for batch, texts in blocks(batches):
        grid = Grid(texts).words(TERM_GAP)
        k1, k2 = (grid.hashes(grid.ws, grid.we, seed, fold=True) for seed in (0, 1))
        _, at = np.unique(np.stack([grid.wdoc.astype(np.uint64), k1, k2], 1), axis=0, return_index=True) if len(k1) else (None, np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids(batch, "item")[grid.wdoc[at]]), longs(k1[at]), longs(k2[at])], ["item", "k1", "k2"])


def item_blocks(items: DataFrame, block_terms: int) -> tuple[DataFrame, list[int]]:
    """(item, k1, k2, block), staged, and the blocks that hold any (an item of many terms leaves a gap after it)."""
    slim = items.select(ordered_id("item_id").alias("item"), F.col("text").cast("string").alias("text"))
    terms = staged(slim.mapInArrow(_item_terms, "item long, k1 long, k2 long").distinct(), "item-terms")
    sizes = terms.groupBy("item").agg(F.count("*").alias("n"))
    upto = running_total(ranged(sizes, [F.col("item")]), [F.col("item")], F.col("n"), "upto", [])
    placed = upto.select("item", F.expr(f"cast(upto div {block_terms} as int)").alias("block"))
    out = staged(terms.join(placed, "item"), "item-blocks")
    return out, sorted(r.block for r in out.select("block").distinct().collect())


def block_index(rows: DataFrame) -> tuple[Index, np.ndarray]:
    """The inverted index of one block's rows, and the items by their numbers."""
    got = rows.select("k1", "k2", "item").toPandas()
    item_ids, number = np.unique(got["item"].to_numpy(), return_inverse=True)
    k1, k2 = (got[k].to_numpy().astype(np.int64).view(np.uint64) for k in ("k1", "k2"))
    order = np.lexsort((number, k2, k1))
    k1, k2, number = k1[order], k2[order], number[order]
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(new)
    return Index(k1[first], k2[first], np.append(first, len(k1)), number.astype(np.int32), len(item_ids)), item_ids


def _term_counts(texts: list[bytes], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each document, and (document, term of the index, occurrences), documents rising."""
    grid = Grid(texts).words(TERM_GAP)
    k1 = grid.hashes(grid.ws, grid.we, 0, fold=True)
    at = np.minimum(np.searchsorted(index.k1, k1), max(0, len(index.k1) - 1))
    met = np.flatnonzero(index.k1[at] == k1)
    met = met[grid.hashes(grid.ws[met], grid.we[met], 1, fold=True) == index.k2[at[met]]]
    pair, times = np.unique(grid.wdoc[met] * len(index.k1) + at[met], return_counts=True)
    return (grid.whi - grid.wlo).astype(np.int64), pair // len(index.k1), pair % len(index.k1), times.astype(np.int64)


def _document_counts(shared: Broadcast):
    """(doc, text) -> (term, n): documents that hold each term of the index, all documents, all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        held = np.zeros(len(index.k1), np.int64)
        docs = terms = 0
        for _, texts in blocks(batches):
            n, _, term, _ = _term_counts(texts, index)
            held += np.bincount(term, minlength=len(held))
            docs += int(np.count_nonzero(n))
            terms += int(n.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [DOCUMENTS, TERMS]), pa.int64()), pa.array(np.append(held[some], [docs, terms]), pa.int64())], ["term", "n"])

    return run


def term_weights(docs: DataFrame, shared: Broadcast) -> Weights:
    """One pass over (doc, text); the driver gets a row for each term of the block."""
    got = dict(docs.mapInArrow(_document_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n = got.get(DOCUMENTS, 0)
    return Weights(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * got.get(t, 0) + 1))) for t in range(len(shared.value.k1))], np.int64), n, got.get(TERMS, 0))


class Heaps:
    """The `most` best (score, document) of each item; equal scores by document."""

    def __init__(self, n_items: int, most: int):
        self.most, self.held = most, 0
        self.least = np.ones(n_items, np.int64)  # a score that may still enter
        self.rows = [np.zeros(0, np.int64)] * 3
        self.waiting: list[list[np.ndarray]] = []

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        ok = score >= self.least[item]
        self.waiting.append([item[ok], score[ok], doc[ok]])
        self.held += int(ok.sum())
        if self.held >= HELD:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """Leave the best of each item; returns item, score, document and place."""
        item, score, doc = (np.concatenate(x) for x in zip(self.rows, *self.waiting, strict=True))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        ok = place < self.most
        self.rows, self.waiting, self.held = [item[ok], score[ok], doc[ok]], [], 0
        full = place == self.most - 1
        self.least[item[full]] = score[full]
        return self.rows


def _slices(weight: np.ndarray, bound: int) -> Iterator[slice]:
    """Runs whose weights add up to at most `bound`, or of one."""
    upto, at = np.cumsum(weight), 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + bound, "right")))
        yield slice(at, end)
        at = end


def _best(shared: Broadcast, item_ids: np.ndarray, weights: Weights, most: int):
    """(doc, text) -> a task's heaps (item, score, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(index.n_items, most)
        holders = np.diff(index.starts)
        for batch, texts in blocks(batches):
            n, doc, term, times = _term_counts(texts, index)
            m = 10 + (90 * n * weights.documents) // max(1, weights.terms)
            share = weights.term[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
            name = ids(batch, "doc")
            # Whole documents at a time: a document's shares, and a score for each item, count.
            cut = np.searchsorted(doc, np.arange(len(n) + 1))
            load = np.concatenate([[0], np.cumsum(holders[term])])[cut]
            for part in _slices(np.diff(load) + index.n_items, HELD):
                lo, hi = cut[part.start], cut[part.stop]
                if lo == hi:
                    continue
                many = holders[term[lo:hi]]
                of = np.repeat(np.arange(lo, hi), many)
                place = index.starts[term[of]] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                total = np.zeros((part.stop - part.start) * index.n_items, np.int64)
                np.add.at(total, (doc[of] - part.start) * index.n_items + index.items[place], share[of])
                some = np.flatnonzero(total)
                heaps.add(some % index.n_items, total[some], name[part.start + some // index.n_items])
        item, score, doc = heaps.settle() if heaps.waiting else heaps.rows
        yield pa.RecordBatch.from_arrays([pa.array(item_ids[item]), pa.array(score), pa.array(doc)], ["item", "score", "doc"])

    return run


def ranked(docs: DataFrame, items: DataFrame, most: int = 10, block_terms: int = 1 << 18) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of each item, scores above 0."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(ordered_id().alias("doc"), F.col("text").cast("string").alias("text")).filter("text is not null")
    terms, held = item_blocks(items, block_terms)
    found = [spark.createDataFrame([], "item long, score long, doc long")]
    for b in held:
        index, item_ids = block_index(terms.filter(F.col("block") == b))
        shared = spark.sparkContext.broadcast(index)
        best = slim.mapInArrow(_best(shared, item_ids, term_weights(slim, shared), most), "item long, score long, doc long")
        found.append(staged(best, "heaps"))
        shared.unpersist()
    merged = reduce(DataFrame.unionByName, found)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    top = merged.withColumn("rank", place).filter(F.col("rank") <= most)
    return top.select(F.nullif("item", F.lit(NO_ID)).alias("item_id"), F.col("rank").cast("int").alias("rank"), shown_id("doc").alias("doc_id"), "score")
