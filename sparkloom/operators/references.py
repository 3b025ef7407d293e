"""Which file a reference means: paths folded against the referring file's folder, looked up by whole path, by index, by the end of a path and by base name.

A path's ends at a slash are keys of their own, so a match by end is an equi-join; candidates carry their rank, and the best of each reference wins, ties to the smallest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.asking import once

#: Endings that a reference may leave out, in the order in which they are tried, and those of an index file; fixed values.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".css", ".astro", ".vue", ".svelte", ".json"]
INDEX_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs"]


def folded(path: Column) -> Column:
    """A path without empty parts and dots, each `..` taken off with the part before it; those that lead out of the root stay."""
    step = lambda kept, x: (
        F.when((x == "") | (x == "."), kept)
        .when((x == "..") & (F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("")) != ".."), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def bare(target: Column) -> Column:
    """A reference without query and fragment, with plain slashes."""
    return F.trim(F.replace(F.regexp_replace(target, "[?#].*$", ""), F.lit("\\"), F.lit("/")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(name: Column) -> Column:
    """A name without its last ending."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def path_ends(path: Column) -> Column:
    """A path and all its ends behind a slash."""
    return once(F.split(path, "/"), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/")))


def _keys(base: Column, names: Column) -> Column:
    """Array of (by, rank, key): base with each ending and as a folder's index, and names as base names."""
    one = lambda by, rank, key: F.struct(F.lit(by).alias("by"), rank.alias("rank"), key.alias("key"))
    paths = [one("path", F.lit(i), F.concat(base, F.lit(e))) for i, e in enumerate(ENDINGS)] + [one("index", F.lit(i), F.concat(base, F.lit("/index"), F.lit(e))) for i, e in enumerate(INDEX_ENDINGS)]
    named = F.transform(names, lambda n, i: F.struct(F.lit("name").alias("by"), i.alias("rank"), n.alias("key")))
    return F.concat(F.when(base != "", F.array(*paths)).otherwise(F.array().cast("array<struct<by: string, rank: int, key: string>>")), named)


def resolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(session_id, src, target, dst, way): the file that each reference (session_id, path, target) means among its session's files (session_id, path).

    A target with ./ or ../ counts from its file's folder; @/ and ~/ stand for a root that isn't known; others with a slash count from the root. These match a whole path, with an ending
    added, an index in a folder of that name, or the end of a path, in this order (way: path, index, end, end_index). Others, and those with a slash from the root that match nothing, match a base name, with
    or without its ending, or a dotted name's last part (way: name). A file doesn't refer to itself.
    """
    spec = bare(F.col("target"))
    near = spec.startswith("./") | spec.startswith("../")
    home = spec.startswith("@/") | spec.startswith("~/")
    folder = F.regexp_replace(F.col("path"), "[^/]*$", "")
    base = F.when(near, folded(F.concat(folder, spec))).when(home, F.substring(spec, 3, 1 << 30)).when(F.contains(spec, F.lit("/")), spec).otherwise("")
    own = base_name(spec)
    names = F.array_compact(F.array(F.nullif(own, F.lit("")), F.nullif(stem(own), F.lit("")), F.when(~F.contains(spec, F.lit("/")) & F.contains(spec, F.lit(".")), F.nullif(F.substring_index(spec, ".", -1), F.lit("")))))
    names = F.when(near | home, F.array().cast("array<string>")).otherwise(names)
    asked = refs.where(spec != "").select("session_id", F.col("path").alias("src"), "target", F.explode(_keys(base, names)).alias("k")).select("session_id", "src", "target", "k.*")
    whole = lambda p: F.transform(path_ends(p), lambda e: F.struct(F.lit("path").alias("kind"), e.alias("key")))
    named = F.transform(F.array_distinct(F.array(F.col("path"), base_name(F.col("path")), stem(base_name(F.col("path"))))), lambda n: F.struct(F.lit("name").alias("kind"), n.alias("key")))
    held = files.select("session_id", F.col("path").alias("dst"), F.explode(F.concat(whole(F.col("path")), named)).alias("h")).select("session_id", "dst", "h.kind", F.col("h.key").alias("key"))
    asked = asked.withColumn("kind", F.when(F.col("by") == "name", "name").otherwise("path"))
    hit = asked.join(held, ["session_id", "kind", "key"])
    full = F.col("key") == F.col("dst")
    way = F.when(F.col("by") == "name", "name").when(full, F.col("by")).otherwise(F.when(F.col("by") == "path", "end").otherwise("end_index"))
    order = F.array_position(F.array(*map(F.lit, ["path", "index", "end", "end_index", "name"])), way)
    best = hit.withColumns({"way": way, "order": order}).groupBy("session_id", "src", "target").agg(F.min(F.struct("order", "rank", "dst", "way")).alias("b"))
    return best.select("session_id", "src", "target", "b.dst", "b.way").where("src <> dst")


def dependencies(files: DataFrame) -> DataFrame:
    """Edges (session_id, src, dst) between files (session_id, path, content) by what their contents refer to: links, imports and styles, and modules."""
    c = F.col("content")
    targets = F.array_distinct(F.concat(T.references(c), T.imported_modules(c)))
    return resolved(files.select("session_id", "path", F.explode(targets).alias("target")), files).select("session_id", "src", "dst").distinct()
