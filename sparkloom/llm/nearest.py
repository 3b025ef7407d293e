"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Unit vectors are projected on DIMS Gaussian directions. The normal law is 2-stable, so a projected squared distance divided
by the true one follows the chi-square law with DIMS degrees of freedom. Neighbours are taken in the order of their projected distance
and verified with the true cosine until the test holds: were a better neighbour than the k-th found so far still to come,
its projected distance would, with probability CONFIDENCE, have been below the current one.

The kd-tree has two levels. Its upper part is fitted to a sample of at most SAMPLE projections and cuts all vectors into cells,
and every vector is put in its cell; a crowded cell is dealt over several blocks of about BLOCK vectors. Each block holds a kd-tree
of its own. A query first searches its own cell; what it finds there bounds, by the same test, which other cells it has to visit.
Vectors travel once, queries to the cells they visit; all else that grows stays in Spark's shuffles.

Nearness is the largest cosine in double precision, ties to the smaller vec_id. Vectors that are null, zero or hold null
or non-finite components, or have a null vec_id, take no part. Only vectors of a query's length are its candidates. Rows with a repeated vec_id are
candidates each, the smallest of their vectors is the query, and a query's own vec_id is none of its candidates. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from ._vectors import chi2_cdf, chi2_quantile, matrix, unit, valid

DIMS = 8
CONFIDENCE = 0.97
#: Projections that the upper part of the tree is fitted to, at most, and its cells, at most.
SAMPLE, CELLS = 65_536, 4_096
BLOCK = 16_384
LEAF = 128


def directions(dim: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, DIMS))


def split(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and thresholds of a kd-tree of 2 ** depth leaves over points, in heap order."""
    axis, at = np.zeros(2**depth, dtype=np.int64), np.zeros(2**depth)
    todo = [(1, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if node >= 2**depth:
            continue
        if len(own):
            spread = points[own].max(axis=0) - points[own].min(axis=0)
            axis[node] = int(spread.argmax())
            at[node] = float(np.median(points[own, axis[node]]))
        left = points[own, axis[node]] <= at[node]
        todo += [(2 * node, own[left]), (2 * node + 1, own[~left])]
    return axis, at


def cell_of(points: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.ones(len(points), dtype=np.int64)
    for _ in range(int(math.log2(len(axis)))):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > at[node])
    return node - len(axis)


def boxes(axis: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the cells."""
    low = np.full((2 * len(axis), DIMS), -np.inf)
    high = np.full((2 * len(axis), DIMS), np.inf)
    for node in range(1, len(axis)):
        for child in (2 * node, 2 * node + 1):
            low[child], high[child] = low[node], high[node]
        high[2 * node, axis[node]] = np.minimum(high[node, axis[node]], at[node])
        low[2 * node + 1, axis[node]] = np.maximum(low[node, axis[node]], at[node])
    return low[len(axis) :], high[len(axis) :]


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of one point to each box."""
    d = np.maximum(np.maximum(low - point, point - high), 0)
    return (d * d).sum(axis=1)


class Block:
    """The kd-tree over one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.projected = unit(x) @ directions(x.shape[1])
        depth = max(0, math.ceil(math.log2(max(1, len(ids) / LEAF))))
        leaf = cell_of(self.projected, *split(self.projected, depth)) if depth else np.zeros(len(ids), dtype=np.int64)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.x, self.projected = ids[order], x[order], self.projected[order]
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.first = np.flatnonzero(np.concatenate(([True], np.diff(leaf[order]) > 0)))
        self.end = np.append(self.first[1:], len(ids))
        self.low, self.high = np.minimum.reduceat(self.projected, self.first), np.maximum.reduceat(self.projected, self.first)

    def nearest(self, own: int, q: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, cosines) that the incremental search meets; bound: a cosine that is known to be reached k times elsewhere."""
        p = unit(q[None])[0] @ directions(len(q))
        norm = math.sqrt((q * q).sum())
        to_leaf = box_distance(p, self.low, self.high)
        leaves = np.argsort(to_leaf, kind="stable")
        stop = chi2_quantile_cached()
        ids, cos = np.zeros(0, np.int64), np.zeros(0)
        pool_at, pool_d = np.zeros(0, np.int64), np.zeros(0)
        i = 0
        while i < len(leaves) or len(pool_at):
            # open some more leaves; what is nearer than the next leaf comes next in the order of projected distance
            step = max(4, i // 2)
            opened = leaves[i : i + step]
            i += len(opened)
            if len(opened):
                at = np.concatenate([np.arange(self.first[n], self.end[n]) for n in opened])
                d = self.projected[at] - p
                pool_at, pool_d = np.append(pool_at, at), np.append(pool_d, (d * d).sum(axis=1))
            reach = to_leaf[leaves[i]] if i < len(leaves) else np.inf
            ready = pool_d <= reach
            at = pool_at[ready]
            pool_at, pool_d = pool_at[~ready], pool_d[~ready]
            at = at[self.ids[at] != own]
            if len(at):
                ids, cos = np.append(ids, self.ids[at]), np.append(cos, (self.x[at] @ q) / (self.norm[at] * norm))
                if len(ids) > k:
                    best = np.lexsort((ids, -cos))[:k]
                    ids, cos = ids[best], cos[best]
            kth = max(bound, cos[k - 1] if len(cos) >= k else -1.0)
            if reach > 1e-12 and reach >= stop * max(0.0, 2 - 2 * kth):
                break
        return ids, cos


_STOP: dict[tuple[float, int], float] = {}


def chi2_quantile_cached() -> float:
    return _STOP.setdefault((CONFIDENCE, DIMS), chi2_quantile(CONFIDENCE, DIMS))


def _place(tree):
    """Adds the cell of each vector."""

    def run(batches):
        trees = tree.value
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            cell = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                cell[own] = cell_of(unit(matrix(batch.column(1).take(pa.array(own)))) @ directions(int(dim)), *trees[int(dim)][:2]) + (int(dim) << 16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["vec_id", "embedding", "cell"])

    return run


def _visits(tree):
    """(query_id, embedding, kth, own cell) -> one row for each other cell that the test can't rule out."""

    def run(batches):
        corners = {dim: boxes(*t[:2]) for dim, t in tree.value.items()}
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                q = np.array(batch.column(1)[i].as_py(), dtype=np.float64)
                p = unit(q[None])[0] @ directions(len(q))
                kth, home = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                reach = np.inf if kth is None else chi2_quantile_cached() * max(0.0, 2 - 2 * kth) + 1e-12
                cells = np.flatnonzero(box_distance(p, *corners[len(q)]) <= reach) + (len(q) << 16)
                out.append(cells[cells != home])
            n = [len(c) for c in out]
            take = pa.array(np.repeat(np.arange(batch.num_rows), n))
            cells = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(cells)], ["query_id", "embedding", "kth", "cell"])

    return run


def _search(k: int):
    """Rows (cell, block, query, id, embedding, kth), whole blocks in order, vectors before queries -> (query_id, vec_id, score)."""

    def finish(vectors, queries):
        if not vectors or not queries:
            return
        v = pa.concat_batches(vectors)
        tree = Block(v.column(3).to_numpy(), matrix(v.column(4)))
        found = []
        for part in queries:
            q = matrix(part.column(4))
            for i in range(part.num_rows):
                own, kth = part.column(3)[i].as_py(), part.column(5)[i].as_py()
                ids, cos = tree.nearest(own, q[i], k, -1.0 if kth is None else kth)
                found.append((np.full(len(ids), own), ids, cos))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(3)], ["query_id", "vec_id", "score"])

    def run(batches):
        now, vectors, queries = None, [], []
        for batch in batches:
            cell, block, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (cell[a], block[a]) != now:
                    yield from finish(vectors, queries)
                    now, vectors, queries = (cell[a], block[a]), [], []
                (queries if query[a] else vectors).append(batch.slice(a, b - a))
        yield from finish(vectors, queries)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all rows of vectors to each row for which the column is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.where(valid("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    counts = rows.groupBy(F.size("embedding").alias("dim")).count()
    sizes = {r[0]: r[1] for r in counts.collect()}  # a row for each length of vectors
    trees = {}
    for dim, n in sizes.items():
        depth = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(n / BLOCK))))
        sample = np.zeros((0, DIMS))
        if depth:
            some = rows.where(F.size("embedding") == dim).where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30)))
            drawn = some.select("embedding").limit(2 * SAMPLE).mapInArrow(_projections, "p array<double>").toArrow()
            sample = matrix(drawn.column(0).combine_chunks()) if drawn.num_rows else sample
        trees[dim] = split(sample, depth)
    tree = spark.sparkContext.broadcast(trees)
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    placed = _shared.written(rows.mapInArrow(_place(tree), f"vec_id long, embedding array<{element}>, cell long"), "cells")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    data = placed.join(F.broadcast(blocks), "cell")  # at most CELLS rows for each length
    data = data.select("cell", F.expr("int(pmod(xxhash64(vec_id), blocks))").alias("block"), F.lit(False).alias("query"), F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("kth"))
    queries = placed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("embedding", "cell")).alias("q")).select("query_id", "q.*")

    def search(asked: DataFrame) -> DataFrame:
        asked = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        asked = asked.select("cell", "block", F.lit(True).alias("query"), F.col("query_id").alias("id"), "embedding", "kth")
        every = data.union(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "query")
        return every.mapInArrow(_search(k), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    home = _shared.written(search(queries.withColumn("kth", F.lit(None).cast("double"))), "home")
    kth = best(home).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    away = queries.join(kth, "query_id", "left").select("query_id", "embedding", "kth", "cell")
    away = away.mapInArrow(_visits(tree), f"query_id long, embedding array<{element}>, kth double, cell long")
    return best(home.union(search(away))).select("query_id", "rank", "vec_id", "score")


def _projections(batches):
    for batch in batches:
        x = matrix(batch.column(0))
        p = unit(x) @ directions(x.shape[1])
        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), DIMS).cast(pa.list_(pa.float64()))], ["p"])


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest neighbours of every fiftieth vector among all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
