"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document's set holds its distinct shingles of `size` words (A-Z lower-cased; with fewer words the
whole sequence is the one shingle). Two documents link when 100 * intersection >= percent * union. The
result names each document's group: the smallest doc_id that links reach.

1. Survey. Documents with equal sets become one node, named by its set; copies need no pairs. Each node
   gets a bitmap of one or two bits for each element, in which every element flips one bit. Each task
   also counts shingles that are frequent in it; the globally most frequent (at most MAX_FREQUENT, about
   1 MB, an order hint only) are broadcast.
2. Prefix rows. All sets are sorted in one global order: infrequent shingles by hash, then frequent ones
   by rising frequency. Linked sets share a shingle within their first n - ceil(percent * n / 100) + 1;
   only these become rows (shingle, node, n), and passages that everybody quotes are rarely among them.
3. Rows are dealt out by shingle and sorted by set size; a streamed pass makes candidate pairs. A shingle
   of at most SMALL nodes is one tile, and gives the pairs of compatible size. A larger one gives only
   pairs with a leader, the smallest set of each size band, and its rows are kept, cut by size into
   chunks of TILE nodes.
4. Two bitmaps differ in at most as many bits as the sets differ in elements, which bounds the overlap
   from above: pairs that can't reach the threshold go.
5. The pairs left are verified by intersecting the sorted arrays, made from the two texts, in two rounds:
   first each node's nearest pair with a smaller node, then those pairs whose ends the links found so far
   don't connect. So the texts that move are about one pair for each near copy, not all pairs of a group.
6. A large shingle whose rows all reached their leader's component is settled, as it needs no more
   links. The rows of others meet in tiles of two chunks whose size bands are compatible. Of the pairs
   of different components that a tile's bitmaps can't rule out, a cheapest spanning forest is verified,
   not all of them.
7. Where a pair of the forest doesn't link, others may. All of these lie inside what the forests connect;
   each node of such a group comes once, with its sorted array, to tiles of the group. A tile verifies its
   pairs itself, nearest first, passes over those that its links connect, and returns links only: fewer
   than it has nodes.

A pair that isn't verified shares no prefix shingle, differs in too many bits, or is in one component
anyway: no link between different components is lost. Names of shingles and sets are 64-bit hashes.

Defined cases: a null or empty text, or one without words, has the empty set, links with nothing and is
its own group; a null doc_id counts as larger than all others, and a group of such rows alone has a null
component_id; repeated rows share their group; an empty table gives an empty result; extra columns are
ignored or come back unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bytegrid import NO_ID, Grid, blocks, ids, inside, longs, mix, span_sums, window_hashes
from newsloom.llm.rows import ordered_id, row_key, shown_id, slim, small_side, whole
from newsloom.operators.components import components
from newsloom.operators.ordered import ranged, running_total
from newsloom.session import staged, unstaged

#: Most shingles whose frequency the global order knows. Any number gives the same result.
MAX_FREQUENT = 1 << 16
#: A shingle is frequent in a task from so many of CHUNK shingles' documents on.
LOCAL_FREQUENT, CHUNK = 8, 1 << 22
#: Most nodes of a shingle whose pairs are listed without bitmaps, and of one side of a tile.
SMALL, TILE = 16, 1024
#: About so many elements of one side of a tile whose sets come along.
ELEMENTS = 1 << 20
#: Candidate pairs that a task gathers before it drops repeated ones.
GATHER = 1 << 19


def shingle_sets(grid: Grid, size: int, rank: "Frequent | None" = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, n by doc): distinct shingles by document, in the global order."""
    h = grid.hashes(grid.ws, grid.we, 0, fold=True)
    starts = np.flatnonzero(inside(grid.wlo, grid.whi, len(h), size))
    s, doc = window_hashes(h, size)[starts], grid.wdoc[starts]
    words = grid.whi - grid.wlo
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        s = np.concatenate([s, mix(span_sums(h, grid.wlo[short], grid.whi[short], 4) + words[short].astype(np.uint64), 40)])
        doc = np.concatenate([doc, short])
    late = rank.of(s) if rank is not None else None
    order = np.lexsort((s, doc) if late is None else (s, late, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return doc, s, np.bincount(doc, minlength=grid.n)


def nodes(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The name of each document's set; 0 for an empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s, 21))])
    last = np.cumsum(n)
    name = mix(total[last] - total[last - n] + n.astype(np.uint64), 22) | np.uint64(1)
    return np.where(n > 0, name, np.uint64(0))


class Frequent:
    """Frequent shingles and their rank by frequency, from 1; 0 for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        rank = np.empty(len(hashes), np.int32)
        rank[np.lexsort((hashes, counts))] = np.arange(1, len(hashes) + 1)
        self.ranks = rank[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int32)
        if len(self.hashes):
            some = np.flatnonzero(self.maybe[s >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, s[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == s[some]
            out[some[hit]] = self.ranks[at[hit]]
        return out


def _survey(size: int):
    """Rows (member, doc, row_key, n, name, bits): members and their node, or frequent shingles and their count."""

    def out(member: bool, doc: np.ndarray, row: np.ndarray, n: np.ndarray, name: np.ndarray, bits: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), member)), longs(doc), longs(row), pa.array(n.astype(np.int64)), longs(name), pa.array(bits, pa.binary())], ["member", "doc", "row_key", "n", "name", "bits"])

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        s, count = np.unique(np.concatenate(parts), return_counts=True)
        many = count >= LOCAL_FREQUENT
        none = np.zeros(int(many.sum()), np.int64)
        return out(False, none, none, count[many], s[many], [b""] * len(none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, np.zeros(0, np.uint64)
        for batch, texts in blocks(batches):
            doc, s, n = shingle_sets(Grid(texts).words(), size)
            name = nodes(doc, s, n)
            own = np.split(s, np.cumsum(n)[:-1])
            yield out(True, ids(batch), ids(batch, "row_key"), n, name, [bitmap(x).tobytes() for x in own])
            fresh = np.zeros(len(n), bool)
            fresh[np.unique(name, return_index=True)[1]] = True
            fresh &= ~np.isin(name, seen)
            parts.append(s[fresh[doc]])
            seen = np.concatenate([seen, name[fresh]])
            held += len(parts[-1])
            if held >= CHUNK:
                yield often(parts)
                parts, held, seen = [], 0, seen[:0]
        if parts:
            yield often(parts)

    return run


def _prefix_rows(size: int, percent: int, frequent: Frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in blocks(batches):
            doc, s, n = shingle_sets(Grid(texts).words(), size, frequent)
            name = nodes(doc, s, n)
            fresh = np.zeros(len(n), bool)
            for d, x in enumerate(name.tolist()):
                if x and x not in seen:  # the same set again adds nothing
                    seen.add(x)
                    fresh[d] = True
            if len(seen) > 1 << 18:
                seen.clear()
            most = n - -(-percent * n // 100) + 1
            place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            take = (place < most[doc]) & fresh[doc]
            yield pa.RecordBatch.from_arrays([longs(s[take]), longs(name[doc[take]]), pa.array(n[doc[take]].astype(np.int32))], ["key", "node", "n"])

    return run


def _candidates(percent: int, small: int = SMALL, tile: int = TILE):
    """Rows sorted by key, size and node -> (large, a, b, key, n, chunk): candidate pairs (a, b), and all
    rows b of large keys with their leader a. Of an open group at most `small` rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        held = 0
        open_: list[tuple[int, int]] = []  # (node, n) of the open group, while it is small
        key = lead = None  # the open group's key; (node, n, rows so far) of the current leader once it is large
        last = (None, None)

        def distinct() -> pa.RecordBatch:
            p = np.concatenate(pairs)
            p.sort(axis=1)
            u = p.view(np.uint64)
            _, at = np.unique(mix(u[:, 0], 1) * np.uint64(3) + mix(u[:, 1], 2), return_index=True)
            none = pa.nulls(len(at), pa.int64())
            return _rows(np.zeros(len(at), bool), p[at, 0], p[at, 1], none, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int32()))

        def compatible(group: list[tuple[int, int]]) -> list[tuple[int, int]]:
            out = []
            for j in range(1, len(group)):
                b, nb = group[j]
                for i in range(j - 1, -1, -1):
                    if 100 * group[i][1] < percent * nb:
                        break  # smaller ones come before
                    out.append((group[i][0], b))
            return out

        def led(large: list, k: int, rows: list[tuple[int, int]]) -> None:
            nonlocal lead
            for x, m in rows:
                node, size, count = lead or (x, m, 0)
                large.append((node, x, k, m, count // tile))
                # The first set that is too large for its leader leads on; its row still shows the former one.
                lead = (x, m, count + 1) if 100 * size < percent * m else (node, size, count + 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes_, sizes = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes_[1:] != nodes_[:-1])
            new[0] = (int(keys[0]), int(nodes_[0])) != last  # the same set from two tasks counts once
            last = (int(keys[-1]), int(nodes_[-1]))
            keys, nodes_, sizes = keys[new], nodes_[new], sizes[new]
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            width = np.diff(cuts)
            inner = np.arange(len(width))
            whole_ = (inner > 0) & (inner < len(width) - 1)  # groups that begin and end in this batch
            two = cuts[:-1][whole_ & (width == 2)]
            two = two[100 * sizes[two].astype(np.int64) >= percent * sizes[two + 1].astype(np.int64)]
            if len(two):
                pairs.append(np.stack([nodes_[two], nodes_[two + 1]], axis=1))
            found: list[tuple[int, int]] = []
            large: list[tuple[int, int, int, int, int]] = []
            for g in np.flatnonzero(~whole_ | (width > 2)).tolist():
                i, j = int(cuts[g]), int(cuts[g + 1])
                if int(keys[i]) != key:
                    found += compatible(open_)
                    key, lead, open_ = int(keys[i]), None, []
                group = list(zip(nodes_[i:j].tolist(), sizes[i:j].tolist(), strict=True))
                if lead is None and len(open_) + len(group) <= small:
                    open_ += group
                else:
                    led(large, key, open_ + group)
                    open_ = []
            if found:
                pairs.append(np.array(found, np.int64))
            if large:
                x = np.array(large, np.int64)
                yield _rows(np.ones(len(x), bool), x[:, 0], x[:, 1], pa.array(x[:, 2]), pa.array(x[:, 3].astype(np.int32)), pa.array(x[:, 4].astype(np.int32)))
            held += sum(map(len, pairs[-2:]))
            if held > GATHER:
                yield distinct()
                pairs, held = [], 0
        found = compatible(open_)
        if found:
            pairs.append(np.array(found, np.int64))
        if pairs:
            yield distinct()

    return run


def _rows(large: np.ndarray, a: np.ndarray, b: np.ndarray, key: pa.Array, n: pa.Array, chunk: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(large), pa.array(a), pa.array(b), key, n, chunk], ["large", "a", "b", "key", "n", "chunk"])


def bitmap_words(n: int) -> int:
    """64-bit words of a set's bitmap: one or two bits for each element, a power of two, the same within a factor two of size."""
    return max(1, 1 << max(0, (n - 1).bit_length() - 6))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Each element flips the bit that its hash names; equal elements of two sets cancel out."""
    words = bitmap_words(len(s))
    bits = np.bincount((mix(s, 23) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Narrower bitmaps of the same sets (rows of `bits`): bit i flips bit i modulo the width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _bounded(percent: int):
    """(a, b, na, nb, bits of both, places of both) -> (a, b, places, differ): pairs that their bitmaps can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            near = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            most = (100 - percent) * (na + nb) // (100 + percent)
            xs, ys = batch.column(4), batch.column(5)
            differ = np.zeros(len(near), np.int32)
            for i in np.flatnonzero(near).tolist():
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                w = min(len(x), len(y))
                differ[i] = int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum())
                near[i] = differ[i] <= most[i]
            take = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (0, 1, 6, 7, 8, 9)), pa.array(differ[near])], ["a", "b", "doc_a", "row_a", "doc_b", "row_b", "differ"])

    return run


PLACED = "a long, b long, doc_a long, row_a long, doc_b long, row_b long, differ int"


def bounded(pairs: DataFrame, nodes_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that may link, and a row of documents that holds each."""
    of = lambda s: nodes_.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}"), F.col("doc").alias(f"doc{s}"), F.col("row_key").alias(f"row{s}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "na", "nb", "bitsa", "bitsb", "doca", "rowa", "docb", "rowb").mapInArrow(_bounded(percent), PLACED)


def arrays(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's set as a sorted array."""
    out: list[np.ndarray] = []
    at, held = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or held and held + len(texts[i]) > 1 << 20:
            _, s, n = shingle_sets(Grid(texts[at:i]).words(), size)
            out += np.split(s, np.cumsum(n)[:-1])
            at, held = i, 0
        held += len(texts[i]) if i < len(texts) else 0
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verify(size: int, percent: int):
    """(a, b, texts of both) -> the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for k in (2, 3):  # a text that meets many others comes to one array
                texts = batch.column(k).cast(pa.binary()).dictionary_encode()
                made = arrays(texts.dictionary.to_pylist(), size)
                sides.append([made[i] for i in texts.indices.to_pylist()])
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                ok[i] = linked(x, y, percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])

    return run


def verified(near: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of the staged table `near` that link, by the texts of `rows`."""
    ends = [near.select(F.col(f"doc_{x}").alias("doc_id"), F.col(f"row_{x}").alias("row_key")) for x in "ab"]
    held = staged(ends[0].unionByName(ends[1]).distinct(), "held")
    # The texts in question leave the documents once; where they are few, no other text moves.
    texts = staged(rows.select("doc_id", "row_key", "text").join(small_side(held, 1 << 18), ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"]), "texts")
    one = near.withColumnsRenamed({"doc_a": "doc_id", "row_a": "row_key"}).join(texts.withColumnRenamed("text", "text_a"), ["doc_id", "row_key"]).drop("doc_id", "row_key")
    two = one.withColumnsRenamed({"doc_b": "doc_id", "row_b": "row_key"}).join(texts.withColumnRenamed("text", "text_b"), ["doc_id", "row_key"])
    links = staged(two.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, percent), "a long, b long"), "links")
    unstaged(texts, held)
    return links


def nearest(near: DataFrame) -> DataFrame:
    """For each node b, its pair that differs in the fewest bits."""
    rest = [c for c in near.columns if c != "b"]
    return near.groupBy("b").agg(F.min(F.struct("differ", *[c for c in rest if c != "differ"])).alias("x")).select("b", "x.*").select(*near.columns)


def connected(near: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root): components of the links among the pairs `near`; a pair inside one component isn't verified."""
    picked = staged(nearest(near), "picked")
    roots = components(verified(picked, rows, size, percent))
    left = staged(apart(near.join(picked.select("a", "b"), ["a", "b"], "left_anti"), roots), "left")
    good = verified(left, rows, size, percent)
    out = components(as_edges(roots).unionByName(good))
    unstaged(picked, left, good)
    return out


def as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that aren't in one component."""
    root_of = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    both = pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _forest(u: np.ndarray, v: np.ndarray, cost: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Of pairs (u, v), those of a cheapest spanning forest over the components. Each round takes every component's cheapest pair."""
    order = np.argsort(cost, kind="stable")
    names, code = np.unique(comp[np.concatenate([u, v])], return_inverse=True)
    a, b = code[: len(u)][order], code[len(u) :][order]
    root = np.arange(len(names))
    taken: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    while len(order):
        _, first = np.unique(np.concatenate([a, b]), return_index=True)
        for e in np.unique(first % len(order)).tolist():
            x, y = find(int(a[e])), find(int(b[e]))
            if x != y:
                root[max(x, y)] = min(x, y)
                taken.append(int(order[e]))
        flat = np.array([find(i) for i in range(len(names))])
        a, b = flat[a], flat[b]
        on = a != b
        order, a, b = order[on], a[on], b[on]
    return np.array(taken, np.int64)


class Tile:
    """Rows (key, tile, node, n, component, bits, right[, shingles]) of one tile; one of a single chunk has left rows only."""

    def __init__(self, rows: list[pa.RecordBatch]):
        batch = rows[0] if len(rows) == 1 else pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        self.key = batch.column(0)[0].as_py()
        self.node, self.n, self.comp = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
        bits, right = batch.column(5), batch.column(6).to_numpy(zero_copy_only=False)
        self.at = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        self.raw = np.frombuffer(bits.buffers()[2] or b"", np.uint8)
        self.words = np.diff(self.at) // 8
        self.sets = batch.column(7) if batch.num_columns > 7 else None
        self.left, self.right = np.flatnonzero(~right), np.flatnonzero(right)

    def bits(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Bitmaps of rows that all have `words` words."""
        return np.ascontiguousarray(self.raw[self.at[rows][:, None] + np.arange(8 * words)]).view(np.uint64)

    def pairs(self, percent: int) -> np.ndarray:
        """(row, row, differing bits): pairs of different components that the bitmaps can't rule out."""
        square = not len(self.right)
        others = self.left if square else self.right
        found: list[np.ndarray] = []
        if len(np.unique(self.comp)) < 2:
            return np.zeros((0, 3), np.int64)
        for w1 in np.unique(self.words[self.left]).tolist():
            mine = self.left[self.words[self.left] == w1]
            for w2 in np.unique(self.words[others]).tolist():
                other = others[self.words[others] == w2]
                n1, n2 = self.n[mine], self.n[other]
                if 100 * n1.max() < percent * n2.min() or 100 * n2.max() < percent * n1.min():
                    continue
                w = min(w1, w2)
                x, y = folded(self.bits(mine, w1), w), folded(self.bits(other, w2), w)
                step = max(1, (1 << 20) // (len(other) * w))
                for i in range(0, len(mine), step):
                    m, k = mine[i : i + step], n1[i : i + step, None]
                    ok = (self.comp[m][:, None] != self.comp[other][None]) & (100 * np.minimum(k, n2) >= percent * np.maximum(k, n2))
                    if square:
                        ok &= self.node[m][:, None] < self.node[other][None]
                    u, v = np.nonzero(ok)
                    if len(u):
                        differ = np.bitwise_count(x[i + u] ^ y[v]).sum(axis=1).astype(np.int64)
                        near = differ <= (100 - percent) * (self.n[m[u]] + n2[v]) // (100 + percent)
                        found.append(np.stack([m[u[near]], other[v[near]], differ[near]], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def forest(self, percent: int) -> np.ndarray:
        """Node pairs of a cheapest spanning forest over the components."""
        p = self.pairs(percent)
        if len(p):
            p = p[_forest(p[:, 0], p[:, 1], p[:, 2], self.comp)]
        return np.sort(np.stack([self.node[p[:, 0]], self.node[p[:, 1]]], axis=1), axis=1)

    def links(self, percent: int) -> np.ndarray:
        """Node pairs that link, enough of them to connect what any pair of the tile connects."""
        p = self.pairs(percent)
        p = p[np.argsort(p[:, 2], kind="stable")]
        root = {c: c for c in self.comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        set_of = lambda i: np.frombuffer(self.sets[i].as_buffer(), np.uint64)
        good = []
        for u, v in p[:, :2].tolist():
            x, y = find(int(self.comp[u])), find(int(self.comp[v]))
            if x != y and linked(set_of(u), set_of(v), percent):
                root[x] = y
                good.append((u, v))
        at = np.array(good, np.int64).reshape(-1, 2)
        return np.sort(np.stack([self.node[at[:, 0]], self.node[at[:, 1]]], axis=1), axis=1)


def _tile_pairs(percent: int):
    """Rows sorted by key and tile -> (key, a, b): a forest of each tile, or its links where rows hold sets. A tile is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        name = None

        def out(tiles_: list[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
            keys, pairs = [], []
            for rows in tiles_:
                if sum(r.num_rows for r in rows) > 1:
                    t = Tile(rows)
                    got = t.forest(percent) if t.sets is None else t.links(percent)
                    keys.append(np.full(len(got), t.key, np.int64))
                    pairs.append(got)
            if keys:
                p = np.concatenate(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(p[:, 0]), pa.array(p[:, 1])], ["key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), [True]])).tolist()
            ended = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                now = (int(key[i]), int(tile[i]))
                if open_ and now != name:
                    ended.append(open_)
                    open_ = []
                name = now
                open_.append(batch.slice(i, j - i))
            yield from out(ended)
        if open_:
            yield from out([open_])

    return run


def tiles(rows: DataFrame, nodes_: DataFrame, known: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """(key, a, b): pairs of different components from rows (key, chunk, node, n) of large shingles or groups: some that may
    link, or with `sets` (node, shingles) some that do, which connect all that any pair of a tile connects."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.withColumn("last", F.max("chunk").over(Window.partitionBy("key")))
    full = full.join(nodes_.select("node", "bits"), "node").join(known.withColumnRenamed("root", "component"), "node", "left")
    full = full.select("key", "chunk", "node", "n", F.coalesce("component", "node").alias("component"), "bits", "last")
    held = []
    if sets is not None:
        full, held = full.join(sets, "node"), ["shingles"]
    one_tile = full.filter("last = 0").select("key", F.lit(0).cast("long").alias("tile"), "node", "n", "component", "bits", F.lit(False).alias("right"), *held)
    bands = rows.groupBy("key", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one = bands.select("key", F.col("chunk").alias("c1"), F.col("hi").alias("hi1"))
    two = bands.select("key", F.col("chunk").alias("c2"), F.col("lo").alias("lo2"))
    met = one.join(two, "key").filter((F.col("c1") <= F.col("c2")) & (100 * F.col("hi1") >= percent * F.col("lo2"))).select("key", "c1", "c2")
    cut = full.filter("last > 0")
    sides = [cut.join(met.filter("c1 < c2" if right else "true"), (cut["key"] == met["key"]) & (cut["chunk"] == met["c2" if right else "c1"])).select(cut["key"], F.xxhash64("c1", "c2").alias("tile"), "node", "n", "component", "bits", F.lit(right).alias("right"), *held) for right in (False, True)]
    return one_tile.unionByName(sides[0]).unionByName(sides[1]).repartition(spread, "key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_tile_pairs(percent), "key long, a long, b long")


def _shingles(size: int):
    """(node, text) -> (node, shingles): the sorted array as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = arrays(batch.column(1).cast(pa.binary()).to_pylist(), size) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return run


def links_between(open_: DataFrame, large: DataFrame, nodes_: DataFrame, roots: DataFrame, rows: DataFrame, size: int, percent: int, tile: int) -> DataFrame:
    """(a, b), staged: links that connect all that is still to be connected among the nodes of `large` (node, n); pairs `open_`
    (a, b) span what may link, but don't link themselves."""
    root_of = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    ends = open_.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    groups = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    inside = large.select("node", "n").distinct().join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    inside = inside.join(groups.select(F.col("node").alias("component"), F.col("root").alias("key")), "component").select("key", "node", "n")
    order = [F.col("key"), F.col("n"), F.col("node")]
    width = F.greatest("n", F.lit(ELEMENTS // tile)).cast("long")
    placed = running_total(ranged(inside, order), order[1:], width, "place", ["key"])
    placed = staged(placed.select("key", F.expr(f"place div {ELEMENTS}").alias("chunk"), "node", "n"), "inside")
    at = nodes_.join(placed.select("node").distinct(), "node", "left_semi").select("node", F.col("doc").alias("doc_id"), "row_key")
    at = staged(at, "held")
    texts = rows.select("doc_id", "row_key", "text").join(small_side(at, 1 << 18), ["doc_id", "row_key"]).dropDuplicates(["node"])
    sets = staged(texts.select("node", "text").mapInArrow(_shingles(size), "node long, shingles binary"), "sets")
    good = staged(tiles(placed, nodes_, roots, percent, sets).select("a", "b"), "links")
    unstaged(placed, at, sets)
    return good


def grouped(docs: DataFrame, size: int = 5, percent: int = 75, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """(doc, row_key, n, root): the set size of each row and its group; rows without words have a null root."""
    rows = slim(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    survey = staged(rows.mapInArrow(_survey(size), "member boolean, doc long, row_key long, n long, name long, bits binary"), "survey")
    members = survey.filter("member").select("doc", "row_key", "n", F.col("name").alias("node"))
    own = survey.filter("member and n > 0").groupBy(F.col("name").alias("node"))
    nodes_ = staged(own.agg(F.max("n").alias("n"), F.min(F.struct("doc", "row_key")).alias("at"), F.min("bits").alias("bits")).select("node", "n", "bits", "at.doc", "at.row_key"), "nodes")
    top = survey.filter("not member").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(MAX_FREQUENT).toArrow()
    frequent = Frequent(top["name"].to_numpy().view(np.uint64), top["n"].to_numpy())

    prefixes = rows.mapInArrow(_prefix_rows(size, percent, frequent), "key long, node long, n int")
    dealt = prefixes.repartition(spread, "key").sortWithinPartitions("key", "n", "node")
    shared = staged(dealt.mapInArrow(_candidates(percent, small, tile), "large boolean, a long, b long, key long, n int, chunk int"), "shared")

    pairs = shared.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = staged(bounded(pairs, nodes_, percent), "near")
    large = shared.filter("large")
    roots = connected(near, rows, size, percent)

    open_ = staged(apart(large.filter("a <> b").select("a", "b").distinct(), roots), "apart")
    if not open_.isEmpty():
        keys = large.join(open_, ["a", "b"]).select("key").distinct()
        left = staged(large.join(keys, "key", "left_semi").select("key", "chunk", F.col("b").alias("node"), "n"), "large")
        asked = staged(tiles(left, nodes_, roots, percent).select("a", "b").distinct(), "asked")
        more = staged(bounded(asked.join(near.select("a", "b"), ["a", "b"], "left_anti"), nodes_, percent), "near")
        good = verified(more, rows, size, percent)
        if not good.isEmpty():
            roots = components(as_edges(roots).unionByName(good))
        # A forest connects what can be connected with one pair for each node of a tile. Only where one of its
        # pairs turns out not to link, others may still.
        open_ = staged(apart(asked, roots), "apart")
        if not open_.isEmpty():
            good = links_between(open_, left, nodes_, roots, rows, size, percent, tile)
            if not good.isEmpty():
                roots = components(as_edges(roots).unionByName(good))
    both = members.join(roots, "node", "left")
    return both.select("doc", "row_key", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))


def component_ids(docs: DataFrame, size: int = 5, percent: int = 75, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    g = staged(grouped(docs, size, percent, small, tile), "groups")
    least = g.filter("root is not null").groupBy("root").agg(F.min("doc").alias("least"))
    both = g.join(least, "root", "left").withColumn("least", F.coalesce("least", "doc"))
    return both.select(shown_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), shown_id("least").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 75, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """One row of `docs` for each group, its smallest doc_id; rows without words all stay."""
    g = staged(grouped(docs, size, percent, small, tile), "groups")
    least = g.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc", "row_key")).alias("x")).select("x.doc", "x.row_key", F.lit(True).alias("one"))
    alone = g.filter("root is null").select("doc", "row_key", F.lit(False).alias("one")).distinct()
    stay = least.unionByName(alone)
    both = docs.select(whole(docs), ordered_id().alias("doc"), row_key().alias("row_key")).join(stay.hint("shuffle_hash"), ["doc", "row_key"])
    turn = F.row_number().over(Window.partitionBy("doc", "row_key").orderBy(F.lit(1)))  # of repeated rows, one
    return both.withColumn("turn", turn).filter("turn = 1 or not one").select("whole.*")
