"""Walks over typed edges of the session graph: what can be reached, in how many steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

STEPS = "node string, hops long"


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (kind, src, dst) that can be walked in either direction."""
    return edges.select("kind", "src", "dst").union(edges.select("kind", F.col("dst").alias("src"), F.col("src").alias("dst")))


def reached(edges: DataFrame, starts: DataFrame, kinds: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(node, hops): the nodes of starts (node), and all that edges (kind, src, dst) lead to from them, with the fewest steps; `kinds` limits the edges, `most` the steps.

    A frontier of new nodes is joined with the edges, round by round, and a node that was met before is no new one, so cycles end. There are as many rounds as the longest of
    the shortest ways has steps. A node that very many edges lead to is one row of the frontier; the edges of a node with very many go through a join that Spark splits.
    """
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(*kinds))
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    seen = cut(starts.select(F.col("node").cast("string").alias("node")).where("node is not null").distinct().withColumn("hops", F.lit(0).cast("long")))
    front, hops = seen, 0
    while most is None or hops < most:
        hops += 1
        step = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hops).cast("long")))
        if not front.head(1):
            break
        seen = cut(seen.union(front))
    return seen


def session_graph(has: dict[str, DataFrame], links: dict[str, DataFrame]) -> DataFrame:
    """Edges (kind, src, dst) of sessions and what they hold.

    has: kind of node to (session_id, id); a session holds it. links: kind of edge to (src, dst), whose names are nodes already. A node's name is its kind and its id.
    """
    out = None
    for kind, rows in has.items():
        part = rows.select(F.lit("has").alias("kind"), F.concat(F.lit("session:"), F.col("session_id").cast("string")).alias("src"), F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("dst"))
        out = part if out is None else out.union(part)
    for kind, rows in links.items():
        out = out.union(rows.select(F.lit(kind).alias("kind"), "src", "dst"))
    return out


def to_delete(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """(node, hops): what a clean-up of some sessions (session_id) takes along: all that is linked with them in any direction but for what another session holds too, and other sessions."""
    name = F.concat(F.lit("session:"), F.col("session_id").cast("string"))
    gone = sessions.select(name.alias("node")).distinct()
    stays = edges.where("kind = 'has'").join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
    held = stays.select("dst").union(stays.select("src")).distinct()
    free = edges.join(held.withColumnRenamed("dst", "x"), F.col("dst") == F.col("x"), "left_anti").join(held.withColumnRenamed("dst", "y"), F.col("src") == F.col("y"), "left_anti")
    return reached(both_ways(free), gone)
