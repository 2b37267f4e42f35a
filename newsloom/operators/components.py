"""Connected components of an edge table by alternating large and small stars.

Each step replaces edges by edges to the smallest neighbour; the number of different edges never grows. A
node of many links is the smaller end of most of them: there its minimum is an aggregate, summed map-side
first, and AQE may split its rows in the join. A few steps suffice for any graph of small depth. Edges of
each step are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import ship, staged, unstaged


EDGES_IN_TASK = 200_000
#: Nodes that a task of `contracted` holds before it starts anew; any number gives the same components.
HELD = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> fewer of the same components: each node's edge to the root of what this task has seen connected."""
    names, root = np.zeros(0, np.int64), np.zeros(0, np.int64)  # nodes in order, and the root of each

    def told() -> pa.RecordBatch:
        on = names != root
        return pa.RecordBatch.from_arrays([pa.array(names[on]), pa.array(root[on])], ["a", "b"])

    for batch in batches:
        ends = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
        every = np.unique(ends)
        fresh = np.setdiff1d(every, names, assume_unique=True)
        if len(fresh):
            names, root = np.concatenate([names, fresh]), np.concatenate([root, fresh])
            order = np.argsort(names)
            names, root = names[order], root[order]
        x, y = (root[np.searchsorted(names, ends[:, i])] for i in (0, 1))
        apart = np.unique(np.stack([x, y], axis=1)[x != y], axis=0)
        if len(apart):
            up: dict[int, int] = {v: v for v in apart.ravel().tolist()}

            def find(v: int) -> int:
                while up[v] != v:
                    up[v] = up[up[v]]
                    v = up[v]
                return v

            for one, two in apart.tolist():
                one, two = find(one), find(two)
                up[max(one, two)] = min(one, two)
            old = np.array(sorted(up), np.int64)
            new = np.array([find(v) for v in old.tolist()], np.int64)
            at = np.minimum(np.searchsorted(old, root), len(old) - 1)
            root = np.where(old[at] == root, new[at], root)
        if len(names) > HELD:
            yield told()
            names, root = names[:0], root[:0]
    yield told()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components, at most one for each node and task, made before anything is shuffled.

    For edges that are many more than their nodes. A node without links to others is left out.
    """
    ship(edges.sparkSession)
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    return both.mapInArrow(_stars, "a long, b long")


def _large_star(edges: DataFrame, k: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).coalesce(k)
    linked = both.filter("b > a").join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame, n: int, k: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these. Here a > b.

    Edges are dealt out by their larger node once; dropping repeated ones, the minimum and the join all use that.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition(n, "a").coalesce(k).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least.hint("merge"), "a")
    # The node's own edge to the smallest one comes from that neighbour's row.
    return linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, root): for each node of `edges` (a, b), the smallest node of its component."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = staged(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    # Few edges need few tasks, however many partitions the session deals out.
    k = max(1, min(n, -(-now.count() // EDGES_IN_TASK)))
    state = None
    for _ in range(most_steps):
        before, now = now, staged(_small_star(_large_star(now, k), n, k), "edges")
        unstaged(before)
        # In a star every edge leads to a root, and no step changes it.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
