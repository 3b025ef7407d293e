"""Outlines of files with the lines that each symbol spans: Python by its syntax tree, other files by patterns; look-ups of them by path."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import files as files_
from .references import path_ends

#: Kinds of symbols that a line shows where there is no syntax tree.
_LINE = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")
SYMBOL = "line long, first long, last long, depth int, kind string, name string"


def python_symbols(text: str) -> list[tuple[int, int, int, int, str, str]]:
    """(line, first, last, depth, kind, name) of each function and class: the line that names it, the lines it spans with its decorators, how deep it lies, and its dotted name.

    Where the text is no Python, lines that begin like a definition count, up to the next that is no deeper.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_lines(text)
    out, todo = [], [(tree, 0, "")]
    while todo:
        node, depth, prefix = todo.pop()
        for child in ast.iter_child_nodes(node):
            kind = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "async def", ast.ClassDef: "class"}.get(type(child))
            if kind:
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append((child.lineno, first, child.end_lineno, depth, kind, prefix + child.name))
            todo.append((child, depth + bool(kind), f"{prefix}{child.name}." if kind else prefix))
    return sorted(out)


def _by_lines(text: str) -> list[tuple[int, int, int, int, str, str]]:
    lines = text.split("\n")
    found = [(i, len(m[1].expandtabs()), m[2], m[3]) for i, x in enumerate(lines, 1) if (m := _LINE.match(x))]
    out = []
    for k, (i, indent, kind, name) in enumerate(found):
        above = [f for f in found[:k] if f[1] < indent]
        last = next((j - 1 for j, other, *_ in found[k + 1 :] if other <= indent), len(lines))
        out.append((i, i, last, len({f[1] for f in above}), kind, name))
    return out


def _outlined(batches):
    width = None
    for batch in batches:
        width = batch.num_columns - 1
        at, rows = [], []
        for i, text in enumerate(batch.column(width).to_pylist()):
            found = python_symbols(text or "")
            at += [i] * len(found)
            rows += found
        taken = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(width)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*taken, *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], [*batch.schema.names[:width], "line", "first", "last", "depth", "kind", "name"])


def symbols(files: DataFrame) -> DataFrame:
    """(session_id, path, line, first, last, depth, kind, name) for files (session_id, path, content); in files other than Python's a symbol reaches to the next one."""
    python = F.col("path").endswith(".py")
    key = ", ".join(f"{n} {t}" for n, t in files.select("session_id", "path").dtypes)
    parsed = files.where(python).select("session_id", "path", "content").mapInArrow(_outlined, f"{key}, {SYMBOL}")
    lines = files.where(~python).select("session_id", "path", F.size(F.split("content", "\n")).cast("long").alias("n"))
    after = F.lead("line").over(Window.partitionBy("session_id", "path").orderBy("line"))
    plain = files_.outline(files.where(~python)).withColumn("after", after).join(lines, ["session_id", "path"])
    plain = plain.select("session_id", "path", "line", F.col("line").alias("first"), F.greatest("line", F.coalesce(F.col("after") - 1, F.col("n"))).alias("last"), F.lit(0).alias("depth"), "kind", "name")
    return parsed.unionByName(plain)


def rendered(found: DataFrame) -> DataFrame:
    """(session_id, path, outline): a line for each symbol."""
    text = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("kind"), F.lit(" "), F.substring_index("name", ".", -1))
    return found.groupBy("session_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "first", "name", text.alias("text")))), lambda x: x["text"]), "\n").alias("outline"))


def lookup(outlines: DataFrame, queries: DataFrame) -> DataFrame:
    """(session_id, query, path, outline) for queries (session_id, query): the outline of that path, else of one that ends in it, or that it ends in, behind a slash; ties to the longest common end, then the smallest path."""
    ends = outlines.select("session_id", "path", "outline", F.explode(path_ends(F.col("path"))).alias("key"))
    asked = queries.select("session_id", "query", F.explode(path_ends(F.col("query"))).alias("key"))
    hit = asked.join(ends, ["session_id", "key"]).where("key = path or key = query")  # one is the end of the other
    best = F.min(F.struct((F.col("path") != F.col("query")).alias("part"), (-F.char_length("key")).alias("less"), "path", "outline")).alias("b")
    return hit.groupBy("session_id", "query").agg(best).select("session_id", "query", "b.path", "b.outline")


def focused(found: DataFrame, query: str, most: int = 80) -> DataFrame:
    """Of each file's symbols the one whose name suits a query best, ties to the first, and the lines that it spans, `most` at most."""
    score = T.keyword_relevance(F.lit(query), F.replace(F.col("name"), F.lit("."), F.lit(" ")))
    best = found.withColumn("score", score).groupBy("session_id", "path").agg(F.max_by(F.struct("name", "first", "last", "score"), F.struct("score", -F.col("first"), -F.col("last"))).alias("b"))
    return best.select("session_id", "path", "b.name", F.col("b.first").alias("first_line"), F.least(F.col("b.last"), F.col("b.first") + most - 1).alias("last_line"), "b.score")
