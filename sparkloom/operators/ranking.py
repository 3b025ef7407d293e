"""Similarity search over stored embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import cosine

#: Queries in one block, and vectors.
BLOCK, VECTORS = 500, 4000
#: What rounding may do to a similarity, and more.
SLACK = 1e-9


def _compared(k: int, more_than: float):
    """Rows (vectors, queries), each a list of (id, embedding), as the pairs that may be among a query's k nearest of its block: all whose similarity doesn't lie below the k-th by more than rounding."""

    def run(batches):
        for batch in batches:
            for vectors, queries in zip(batch.column(0), batch.column(1), strict=True):
                ids, found = vectors.values.field(0), vectors.values.field(1)
                sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
                asked = queries.values
                flat = [np.asarray(q.as_py() or [], dtype=np.float64) for q in asked.field(1)]
                for size in {len(q) for q in flat} - {0}:
                    rows, own = np.flatnonzero(sizes == size), [i for i, q in enumerate(flat) if len(q) == size]
                    if not len(rows):
                        continue
                    x = found.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                    q = np.stack([flat[i] for i in own])
                    norms = np.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1)))
                    near = np.divide(q @ x.T, norms, out=np.zeros_like(norms), where=norms > 0)
                    kth = np.partition(near, -min(k, len(rows)), axis=1)[:, -min(k, len(rows))]
                    i, j = np.nonzero(near >= np.maximum(kth, more_than)[:, None] - SLACK)
                    at, to = pa.array(np.asarray(own)[i]), pa.array(rows[j])
                    yield pa.RecordBatch.from_arrays([asked.field(0).take(at), asked.field(1).take(at), ids.take(to), found.take(to)], ["query_id", "q", "id", "embedding"])

    return run


def semantic_top(vectors: DataFrame, queries: DataFrame, k: int = 10, more_than: float = 0.05) -> DataFrame:
    """The k rows of vectors (id, embedding) nearest to each query (query_id, embedding) by cosine, above a floor of 0 or more; rows without embedding, or of another length, take no part.

    queries is a stated set, which is compared with all vectors: both are dealt into blocks, each block of queries meets each block of vectors in one join, as matrices, and only what may be among a query's k nearest goes on
    to have its similarity worked out in the JVM, by which it is ranked.
    """
    held = vectors.where(F.size("embedding") > 0).select("id", "embedding")
    few = queries.where(F.size("embedding") > 0).select("query_id", F.col("embedding").alias("q"))
    blocks = max(1, -(-held.count() // VECTORS))
    own = held.groupBy(F.pmod(F.xxhash64("id", "embedding"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "embedding")).alias("vectors"))  # about VECTORS rows
    asked = few.groupBy(F.pmod(F.xxhash64("query_id", "q"), F.lit(max(1, -(-few.count() // BLOCK)))).alias("part")).agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
    asked = asked.select("queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    kinds = dict(held.dtypes) | dict(few.dtypes)
    near = own.join(asked, "block").select("vectors", "queries").mapInArrow(_compared(k, more_than), ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "q", "id", "embedding")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    pairs = near.select("query_id", "id", cosine(F.col("embedding"), F.col("q")).alias("similarity")).where(F.col("similarity") > more_than)
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def label_centroid_similarity(vectors: DataFrame) -> DataFrame:
    """Vectors and mean length for each label."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.groupBy("label").agg(F.count("*").alias("vectors"), F.avg(norm).alias("mean_norm"))
