"""Merkle manifest of a table with an authentication path for each row, by fractal traversal.

Rows become leaves. Within each tree (a language), leaves ascend by id; every two consecutive nodes of a level become one, an odd last one by itself, until one is left. The trees'
roots, in order of their languages, are the leaves of one more tree.

A tree is cut into aligned blocks of 2 ** LEVELS nodes. A block's traversal holds, for each STEP levels, the existing subtree that the present
leaf's path runs through, and the desired one to its right, which grows by two steps for each leaf that is given out; so it holds a few dozen nodes, whatever the path's length, and the
successive paths come out one after another. Blocks' roots are nodes of the next round, until each tree is one node; the rounds' paths are joined
to the blocks below them, as the upper part of their leaves' proofs. A round has one 256th of the rows of the one before.

Order within trees comes from one range-partitioned sort by (language, id, leaf, a running number); places are counted by partition, so no tree is held by one task, and rows that are
equal are split like others. A block is one row of at most 256 leaves. Nothing is broadcast by force.

Null languages are one tree, the first; null ids come first in theirs. Null fields have their own mark in the leaf. Empty texts and fields differ from null ones. Rows with one id are ordered by leaf; equal
rows are leaves of their own, with proofs of their own. A tree of one row is its leaf, and its proof has only what lies above it. An empty table gives no rows.
Very long texts are hashed where they are read and go no further. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

#: Levels of an aligned block, and of each of its stacked subtrees.
LEVELS, STEP = 8, 2
#: Leaves whose crc32 this divides are tampered with in the query.
SEVENTH = 7
PATH = "array<struct<left: boolean, hash: string>>"


def above(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node over two; an absent right one leaves the left one alone."""
    return None if left is None else hashlib.sha256(left + (right or b"")).hexdigest().encode()


class Growing:
    """A subtree over 2 ** top leaves from `start` on, built leaf by leaf; keeps the nodes of levels low to top - 1."""

    def __init__(self, leaves: list[bytes], start: int, low: int, top: int):
        self.leaves, self.next, self.low, self.top = leaves, start, low, top
        self.stack: list[tuple[int, int, bytes | None]] = []
        self.kept: dict[tuple[int, int], bytes | None] = {}

    def step(self) -> None:
        """One more node: the one over the last two, or else the next leaf."""
        stack = self.stack
        if stack and stack[-1][0] == self.top:
            return
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, i, right), (_, _, left) = stack.pop(), stack.pop()
            node = (level + 1, i >> 1, above(left, right))
        else:
            node = (0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
            self.next += 1
        stack.append(node)
        if self.low <= node[0] < self.top:
            self.kept[node[:2]] = node[2]

    def done(self) -> Growing:
        while not self.stack or self.stack[-1][0] < self.top:
            self.step()
        return self


def height(n: int) -> int:
    """Levels over the nodes of a block in a tree whose level has n nodes."""
    return min(LEVELS, max(0, n - 1).bit_length())


def root_of(leaves: list[bytes], levels: int) -> bytes:
    return Growing(leaves, 0, levels, levels).done().stack[0][2]


def traversal(leaves: list[bytes], levels: int):
    """For each leaf in turn, its siblings from the lowest level up; None where a node stands alone."""
    cuts = [(low, min(low + STEP, levels)) for low in range(0, levels, STEP)]
    existing = [Growing(leaves, 0, low, top).done().kept for low, top in cuts]
    desired = [Growing(leaves, 1 << top, low, top) for low, top in cuts]
    for at in range(len(leaves)):
        yield [existing[level // STEP].get((level, (at >> level) ^ 1)) for level in range(levels)]
        for i, (low, top) in enumerate(cuts[:-1]):  # the topmost subtree lasts for the whole block
            desired[i].step()
            desired[i].step()
            if (at + 1) % (1 << top) == 0:
                existing[i] = desired[i].done().kept
                desired[i] = Growing(leaves, (at + 1) + (1 << top), low, top)


def fold(node: bytes, at: int, siblings: list[bytes | None]) -> bytes:
    for level, s in enumerate(siblings):
        node = above(s, node) if s is not None and at >> level & 1 else above(node, s)
    return node


def fold_marked(node: bytes, path: list[tuple[bool, bytes | None]]) -> bytes:
    for left, s in path:
        node = above(s, node) if left else above(node, s)
    return node


def _strings(column: pa.Array) -> list[list[bytes]]:
    return [[x.encode() for x in row] for row in column.to_pylist()]


def _roots(batches):
    for batch in batches:
        tops = [root_of(x, height(n)) for x, n in zip(_strings(batch.column(3)), batch.column(2).to_pylist(), strict=True)]
        n = pa.array([-(-x >> LEVELS) for x in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array([t.decode() for t in tops])], ["tree", "idx", "n", "node"])


def _paths(batches):
    """Blocks (tree, block, n, nodes, root, path) as nodes with whole paths."""
    for batch in batches:
        for tree, block, n, nodes, root, upper in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            nodes = [x.encode() for x in nodes]
            out = []
            for at, siblings in enumerate(traversal(nodes, height(n))):
                out.append([{"left": bool(s is not None and at >> k & 1), "hash": None if s is None else s.decode()} for k, s in enumerate(siblings)] + upper)
            m, first = len(nodes), block << LEVELS
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * m, batch.schema.field(0).type), pa.array(range(first, first + m), pa.int64()), pa.array([root] * m, pa.string()), pa.array(out, pa.list_(pa.struct([("left", pa.bool_()), ("hash", pa.string())])))],
                ["tree", "idx", "root", "path"],
            )


def _proofs(batches):
    """Blocks (items of (at, doc_id, leaf, tampered), n, subroot, root, path) as rows with digests of their proofs."""
    kind = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
    for batch in batches:
        for items, n, subroot, root, path in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            upper = [(p["left"], None if p["hash"] is None else p["hash"].encode()) for p in path]
            rest = b"".join(s for _, s in upper if s is not None)
            ends: dict[bytes, str] = {}  # block root, right or wrong: the whole fold
            rows = []
            leaves = [x["leaf"].encode() for x in items]
            for at, (x, siblings) in enumerate(zip(items, traversal(leaves, height(n)), strict=True)):
                top = fold(leaves[at] if x["tampered"] is None else x["tampered"].encode(), at, siblings)
                if top not in ends:
                    ends[top] = fold_marked(top, upper).decode()
                proof = hashlib.sha256(b"".join(s for s in siblings if s is not None) + rest).hexdigest()
                rows.append((x["doc_id"], x["leaf"], subroot, root, proof, ends[top], ends[top] == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with idx, the place within their tree (null is a tree) in ascending order, nulls first, and n, the tree's rows."""
    by = [F.col(c).asc_nulls_first() for c in [tree, *order]] + [F.col("salt_")]
    salted = rows.withColumn("salt_", F.monotonically_increasing_id())  # lets equal rows lie in several partitions
    line = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt_").withColumn("at_", F.monotonically_increasing_id())
    line = _shared.written(line, "line")
    part = F.shiftright("at_", 33)
    runs = line.groupBy(F.col(tree).alias("t_"), part.alias("part_")).agg(F.min("at_").alias("first_"), F.count("*").alias("m_"))
    upto = Window.partitionBy("t_").orderBy("part_")  # one row for each partition
    runs = runs.select("t_", "part_", "first_", (F.sum("m_").over(upto) - F.col("m_")).alias("before_"), F.sum("m_").over(Window.partitionBy("t_")).alias("n"))
    out = line.withColumn("p_", part).join(runs, F.col(tree).eqNullSafe(F.col("t_")) & (F.col("p_") == F.col("part_")))
    return out.select(*rows.columns, (F.col("at_") - F.col("first_") + F.col("before_")).alias("idx"), "n")


def _blocks(nodes: DataFrame, *item: str) -> DataFrame:
    """(tree, block, n, items) of nodes (tree, idx, n, ...)."""
    block = F.shiftright("idx", LEVELS).alias("block")
    items = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), *item)))  # 2 ** LEVELS at most
    return nodes.groupBy("tree", block).agg(F.first("n").alias("n"), items.alias("items"))


def _rooted(blocks: DataFrame, node: str) -> DataFrame:
    kind = dict(blocks.dtypes)["tree"]
    return blocks.select("tree", "block", "n", F.col(f"items.{node}").alias("nodes")).mapInArrow(_roots, f"tree {kind}, idx long, n long, node string")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, idx, root, path) for nodes (tree, idx, n, node): the tree's root, and the path up to it."""
    nodes = _shared.written(nodes, "nodes")
    if not nodes.where("n > 1").head(1):
        return nodes.select("tree", "idx", F.col("node").alias("root"), F.expr(f"cast(array() as {PATH})").alias("path"))
    blocks = _shared.written(_blocks(nodes, "node"), "blocks")
    whole = _under(blocks, paths(_rooted(blocks, "node"))).select("tree", "block", "n", F.col("items.node").alias("nodes"), "root", "path")
    return _shared.written(whole.mapInArrow(_paths, f"tree {dict(nodes.dtypes)['tree']}, idx long, root string, path {PATH}"), "paths")


def _under(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    up = upper.select(F.col("tree").alias("t_"), F.col("idx").alias("i_"), "root", "path")
    return blocks.join(up, F.col("tree").eqNullSafe(F.col("t_")) & (F.col("block") == F.col("i_"))).drop("t_", "i_")


def proofs(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for leaves (tree, doc_id, leaf, tampered); tampered is null where the leaf is as it was."""
    placed = numbered(leaves, "tree", ["doc_id", "leaf"])
    blocks = _shared.written(_blocks(placed, "doc_id", "leaf", "tampered"), "blocks")
    _shared.drop(leaves, placed)
    inner = paths(_rooted(blocks, "leaf"))
    roots = numbered(inner.where("idx = 0").select(F.lit(0).alias("all_"), F.col("tree").alias("lang"), F.col("root").alias("node")), "all_", ["lang"])
    roots = _shared.written(roots, "subroots")
    outer = paths(roots.select(F.col("all_").alias("tree"), "idx", "n", "node")).select(F.col("idx").alias("j_"), F.col("root").alias("whole"), F.col("path").alias("last"))
    outer = roots.select(F.col("lang").alias("l_"), "idx").join(outer, F.col("idx") == F.col("j_")).drop("idx", "j_")
    upper = _under(blocks, inner).join(outer, F.col("tree").eqNullSafe(F.col("l_")))
    upper = upper.select("items", "n", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("path", "last").alias("path"))
    return upper.mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _field(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(n_chars: Column) -> Column:
    """The leaf of a row of documents, with n_chars (string) as given."""
    rest = [_field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang")]
    return F.sha2(F.concat(*rest, _field(n_chars), _field(F.col("text").cast("string"))), 256)


def manifest(docs: DataFrame, tampers: Column | None = None) -> DataFrame:
    """proofs() of documents by language; where `tampers` holds, the leaf that is folded has 1 more in n_chars."""
    n = F.col("n_chars").cast("decimal(20,0)")
    other = F.when(F.coalesce(tampers, F.lit(False)) & n.isNotNull(), leaf((n + 1).cast("decimal(20,0)").cast("string"))) if tampers is not None else F.lit(None).cast("string")
    rows = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("n_chars").cast("string")).alias("leaf"), other.alias("tampered"))
    return proofs(_shared.written(rows, "leaves"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents with their proofs, a seventh of them tampered with."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % SEVENTH == 0)
