"""One hierarchical navigable small-world graph, as flat neighbour arrays, worked on for many points at once.

Nodes are numbered by falling level, so that the nodes of level l are 0 to sizes[l] - 1, a level's links are
one array of sizes[l] rows of `degree` (-1: none), and node 0, the entry, is on the top level. Points are
inserted in that order, in batches no larger than what the graph holds already: each batch is searched for in
the graph as it stands, and among its own earlier points. A node keeps near neighbours that are nearer to
it than to each other, filled up with the nearest others; it is linked back, and a node that is full keeps the best by
the same rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points searched for at once; bounds the memory of a search.
BATCH = 256
#: Nodes of a beam that are expanded in one step.
WIDTH = 4


@dataclass
class Graph:
    points: np.ndarray
    sizes: list[int]
    links: list[np.ndarray]


def levels_of(uniform: np.ndarray, degree: int) -> np.ndarray:
    """The level of each node, from uniform values in (0, 1]; at least one node has the top level."""
    return np.floor(-np.log(uniform) / np.log(degree)).astype(np.int64)


def _distances(points: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    gap = points[nodes] - queries
    return np.einsum("md,md->m", gap, gap)


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The `ef` nearest nodes met from `entries` (a row for each query), nearest first: nodes (-1: none) and squared distances."""
    q, n = len(queries), len(points)
    rows = np.arange(q)
    seen = np.zeros((q, n), bool)
    nodes = np.full((q, ef), -1, np.int64)
    far = np.full((q, ef), np.inf, points.dtype)
    open_ = np.zeros((q, ef), bool)

    def merge(at: np.ndarray, new: np.ndarray) -> None:
        """Nodes `new` of queries `at` (rising), met for the first time, enter the beams if they are near enough."""
        nonlocal nodes, far, open_
        d = _distances(points, new, queries[at])
        ok = d < far[at, -1]
        at, new, d = at[ok], new[ok], d[ok]
        if not len(at):
            return
        turn = np.arange(len(at)) - np.searchsorted(at, at)
        k = int(turn.max()) + 1
        more_d = np.full((q, k), np.inf, points.dtype)
        more_n = np.full((q, k), -1, np.int64)
        more_d[at, turn], more_n[at, turn] = d, new
        all_d = np.concatenate([far, more_d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        far = np.take_along_axis(all_d, order, 1)
        nodes = np.take_along_axis(np.concatenate([nodes, more_n], 1), order, 1)
        open_ = np.take_along_axis(np.concatenate([open_, more_n >= 0], 1), order, 1)

    at, col = np.nonzero(entries >= 0)
    new = entries[at, col]
    seen[at, new] = True
    merge(at, new)
    while True:
        pick = open_ & (np.cumsum(open_, 1) <= WIDTH)
        at, col = np.nonzero(pick)
        if not len(at):
            return nodes, far
        open_ &= ~pick
        near = links[nodes[at, col]]
        of = np.repeat(at, near.shape[1])
        near = near.ravel()
        ok = near >= 0
        of, near = of[ok], near[ok]
        ok = ~seen[of, near]
        key = np.unique(of[ok] * n + near[ok])
        of, near = key // n, key % n
        seen[of, near] = True
        merge(of, near)


def _chosen(points: np.ndarray, nodes: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first: those nearer to the row's node than to each other, then the nearest others, up to `most`."""
    r, c = nodes.shape
    x = points[np.maximum(nodes, 0)]
    norm = np.einsum("rcd,rcd->rc", x, x)
    apart = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    least = np.full((r, c), np.inf, points.dtype)  # distance to the nearest chosen one
    taken = np.zeros((r, c), bool)
    count = np.zeros(r, np.int64)
    for j in range(c):
        ok = (nodes[:, j] >= 0) & (least[:, j] > far[:, j]) & (count < most)
        taken[:, j] = ok
        count += ok
        least[ok] = np.minimum(least[ok], apart[ok, j])
    order = np.argsort(np.where(nodes < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(nodes, order, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(points: np.ndarray, links: np.ndarray, first: int, chosen: np.ndarray) -> None:
    """The chosen neighbours of the nodes from `first` on get links to them."""
    i, j = np.nonzero(chosen >= 0)
    target, source = chosen[i, j], i + first
    order = np.lexsort((source, target))
    target, source = target[order], source[order]
    turn = np.arange(len(target)) - np.searchsorted(target, target)
    held = np.count_nonzero(links >= 0, axis=1)
    place = held[target] + turn
    degree = links.shape[1]
    full = np.unique(target[place >= degree])
    free = ~np.isin(target, full)
    links[target[free], place[free]] = source[free]
    if not len(full):
        return
    row = np.searchsorted(full, target[~free])
    near = source[~free]
    for lo in range(0, len(full), BATCH):
        hi = min(lo + BATCH, len(full))
        a, b = np.searchsorted(row, [lo, hi])
        wide = np.full((hi - lo, degree + int(turn[~free][a:b].max()) + 1), -1, np.int64)
        wide[:, :degree] = links[full[lo:hi]]
        wide[row[a:b] - lo, degree + turn[~free][a:b]] = near[a:b]
        own = np.repeat(full[lo:hi], wide.shape[1])
        d = _distances(points, np.maximum(wide.ravel(), 0), points[own]).reshape(wide.shape)
        d[wide < 0] = np.inf
        by = np.argsort(d, axis=1, kind="stable")[:, : 2 * degree]
        links[full[lo:hi]] = _chosen(points, np.take_along_axis(wide, by, 1), np.take_along_axis(d, by, 1), degree)


def build(points: np.ndarray, level: np.ndarray, degree: int, ef: int) -> Graph:
    """The graph over `points`, whose levels fall."""
    n = len(points)
    top = int(level[0]) if n else 0
    sizes = [int(np.searchsorted(-level, -l, "right")) for l in range(top + 1)]
    links = [np.full((s, degree * (2 if l == 0 else 1)), -1, np.int64) for l, s in enumerate(sizes)]
    lo = 1
    while lo < n:
        hi = min(n, lo + min(lo, BATCH))
        x = points[lo:hi]
        entries = np.zeros((hi - lo, 1), np.int64)
        gap = np.einsum("id,id->i", x, x)
        inner = gap[:, None] + gap[None, :] - 2 * x @ x.T
        inner[np.triu_indices(hi - lo)] = np.inf  # earlier points of the batch only
        for l in range(top, -1, -1):
            live = max(0, min(hi, sizes[l]) - lo)  # points of the batch on this level
            wide = ef if live else 1
            held = links[l][: min(lo, sizes[l])]
            nodes, far = beam_search(points[: len(held)], held, x, entries, wide)
            entries = nodes[:, : max(1, min(wide, 4))]
            if not live:
                continue
            some = min(live, degree)
            near = np.argsort(inner[:live, :live], axis=1, kind="stable")[:, :some]
            d = np.take_along_axis(inner[:live, :live], near, 1)
            both_d = np.concatenate([far[:live], np.maximum(d, 0)], 1)
            both_n = np.concatenate([nodes[:live], np.where(np.isinf(d), -1, near + lo)], 1)
            by = np.argsort(both_d, axis=1, kind="stable")[:, :ef]
            chosen = _chosen(points, np.take_along_axis(both_n, by, 1), np.take_along_axis(both_d, by, 1), degree)
            links[l][lo : lo + live, :degree] = chosen
            _link_back(points, links[l], lo, chosen)
        lo = hi
    return Graph(points, sizes, links)


def search(graph: Graph, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The `ef` nearest nodes found for each query, nearest first: nodes (-1: none) and squared distances."""
    entries = np.zeros((len(queries), 1), np.int64)
    for size, links in zip(graph.sizes[:0:-1], graph.links[:0:-1], strict=True):
        entries = beam_search(graph.points[:size], links, queries, entries, 1)[0]
    return beam_search(graph.points, graph.links[0], queries, entries, ef)
