"""Approximate nearest neighbours: a navigable small-world graph for each shard, shard results merged.

1. Equal vectors are one node, named by 128-bit hashes and its smallest vec_id. Of a node's ids the
   `most` + 1 smallest are kept: with ties going to smaller ids, no other can be among the nearest.
2. Nodes are dealt to shards of about `shard_rows` by hash, and each shard is made a graph (see hnsw.py),
   written as one row with flat arrays: vectors, level sizes, neighbours.
3. Every query meets every shard. A task reads a shard's row and then streams its queries; a shard's queries
   come in groups of about `group`, so that they are not all one task's.
4. Each shard answers with its nearest nodes, distances computed anew in double precision; they are merged by
   query, nodes give way to their ids, and the query's own id goes.

Every vector is indexed and every query searches all shards. The search is approximate: `ef` nodes are held in
a shard's beam. `recall` measures it. Work grows with queries times shards; larger shards (they are bounded by
a task's memory) need fewer searches.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; only
vectors of one length are compared; rows equal in id and vector count once; of different vectors with one
id each is a candidate, and the smallest of them (as an array) is the query; a null vec_id comes after all
others at equal distances; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import hnsw
from newsloom.llm.bytegrid import longs, mix
from newsloom.llm.rows import ordered_id, shown_id
from newsloom.session import ship, staged

SHARD = "dim int, shard long, k1 array<long>, k2 array<long>, least array<long>, vectors binary, sizes array<int>, neighbours binary"
FOUND = "query_id long, k1 long, k2 long, least long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v): vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(ordered_id("vec_id").alias("id"), v.alias("v")).filter("v is not null")
    fine = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return fine.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 counts as 0.0


def members(rows: DataFrame, most: int) -> DataFrame:
    """(k1, k2, id, turn, dim, v): the `most` + 1 smallest ids of each distinct vector; v is null but for the first."""
    named = rows.select("id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), "v").dropDuplicates(["id", "k1", "k2"])
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    few = named.withColumn("turn", turn).filter(F.col("turn") <= most + 1)
    return few.select("k1", "k2", "id", "turn", F.size("v").alias("dim"), F.when(F.col("turn") == 1, F.col("v")).alias("v"))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.dtype]:
    """Points around their mean; single precision, unless their size forbids."""
    middle = x.mean(0)
    size = float(np.abs(x).max())
    return middle, np.dtype(np.float32 if 1e-15 < size < 1e15 else np.float64)


def _shard(degree: int, ef: int):
    """A shard's nodes -> its row."""

    def run(nodes: pa.Table) -> pa.Table:
        k1, k2 = (nodes[k].to_numpy().astype(np.int64).view(np.uint64) for k in ("k1", "k2"))
        level = hnsw.levels_of((mix(k1 ^ k2, 11) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54, degree)
        order = np.lexsort((k2, k1, -level))
        k1, k2, level, least = k1[order], k2[order], level[order], nodes["id"].to_numpy()[order]
        dim = nodes["dim"][0].as_py()
        x = nodes["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
        middle, kind = _scaled(x)
        graph = hnsw.build((x - middle).astype(kind), level, degree, ef)
        flat = np.concatenate([g.ravel() for g in graph.links]).astype(np.int32)
        one = lambda a: pa.array([a], pa.list_(pa.int64()))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": nodes["shard"].slice(0, 1), "k1": one(k1.view(np.int64)), "k2": one(k2.view(np.int64)), "least": one(least),
            "vectors": pa.array([x.tobytes()], pa.binary()), "sizes": pa.array([graph.sizes], pa.list_(pa.int32())), "neighbours": pa.array([flat.tobytes()], pa.binary()),
        })

    return run


def shards(nodes: DataFrame, shard_rows: int, degree: int, ef: int) -> DataFrame:
    """The index of nodes (k1, k2, id, dim, v): a row for each shard."""
    sizes = staged(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards")), "shard-counts")
    total = sizes.agg(F.sum("shards")).first()[0] or 0
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("k2", F.lit(5)), "shards")).drop("shards")
    # A number of tasks that Spark won't lower for small rows: a shard's work is in its graph, not in its bytes.
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total)
    return dealt.repartition(n, "dim", "shard").groupBy("dim", "shard").applyInArrow(_shard(degree, ef), SHARD)


def _open(row: dict, degree: int) -> tuple[hnsw.Graph, np.ndarray, np.ndarray]:
    """A shard's graph, its vectors in double precision, and their mean."""
    x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    middle, kind = _scaled(x)
    flat, links, at = np.frombuffer(row["neighbours"], np.int32), [], 0
    for level, size in enumerate(row["sizes"]):
        width = degree * (2 if level == 0 else 1)
        links.append(flat[at : at + size * width].reshape(size, width).astype(np.int64))
        at += size * width
    return hnsw.Graph((x - middle).astype(kind), list(row["sizes"]), links), x, middle


def _exact(x: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components summed in their order; inf where there is no node."""
    gap = x[np.maximum(nodes, 0)] - queries[:, None, :]
    d = np.sqrt(np.add.accumulate(gap * gap, axis=2)[:, :, -1])
    return np.where(nodes < 0, np.inf, d)


def _answers(degree: int, ef: int, most: int):
    """Rows of a unit, its shard first and then its queries -> FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = x = middle = shard = None
        for batch in batches:
            is_query = np.flatnonzero(batch.column(batch.schema.get_field_index("id")).is_valid().to_numpy(zero_copy_only=False))
            heads = np.setdiff1d(np.arange(batch.num_rows), is_query)
            # Between the shards' own rows lie the queries of the one before.
            for lo, hi in zip(np.append(-1, heads), np.append(heads, batch.num_rows), strict=True):
                if lo >= 0:
                    row = batch.slice(int(lo), 1).to_pylist()[0]
                    graph, x, middle = _open(row, degree)
                    shard = [np.array(row[k], np.int64) for k in ("k1", "k2", "least")]
                for at in range(int(lo) + 1, int(hi), hnsw.BATCH):
                    part = batch.slice(at, min(hnsw.BATCH, int(hi) - at))
                    q = part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    nodes, _ = hnsw.search(graph, (q - middle).astype(graph.points.dtype), max(ef, most + 1))
                    nodes = nodes[:, : 4 * (most + 1)]
                    d = _exact(x, nodes, q)
                    least = np.where(nodes < 0, np.iinfo(np.int64).max, shard[2][np.maximum(nodes, 0)])
                    order = np.lexsort((least, d), axis=1)[:, : most + 1]
                    nodes, d = np.take_along_axis(nodes, order, 1), np.take_along_axis(d, order, 1)
                    i, j = np.nonzero(nodes >= 0)
                    got = nodes[i, j]
                    ids = part.column(part.schema.get_field_index("id")).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), *(longs(k[got]) for k in shard), pa.array(d[i, j])], ["query_id", "k1", "k2", "least", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 100, most: int = 10, shard_rows: int = 8192, degree: int = 24, ef_build: int = 96, ef: int = 200, group: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, the nearest other rows found."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    held = staged(members(rows, most), "members")
    index = staged(shards(held.filter("turn = 1").select("k1", "k2", "id", "dim", "v"), shard_rows, degree, ef_build), "shards")

    asked = rows.filter((F.col("id") % every == 0) & shown_id("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = staged(asked, "asked")
    groups = max(1, -(-asked.count() // group))
    # A unit is a shard and one group of queries.
    names = index.select("dim", "shard")
    of_queries = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups))).join(names, "dim")
    of_shards = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    units = of_shards.unionByName(of_queries, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = units.repartition(n, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", F.col("id").asc_nulls_first())
    found = met.mapInArrow(_answers(degree, ef, most), FOUND)

    near = Window.partitionBy("query_id").orderBy("score", "least")
    best = found.withColumn("turn", F.row_number().over(near)).filter(F.col("turn") <= most + 1).drop("turn", "least")
    shown = best.join(held.select("k1", "k2", F.col("id").alias("vec_id")), ["k1", "k2"]).filter("vec_id <> query_id").dropDuplicates(["query_id", "vec_id", "score"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return shown.withColumn("rank", place).filter(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), shown_id("vec_id").alias("vec_id"), "score")
