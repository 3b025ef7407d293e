"""File caches, lookups, outlines, references and dependency ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".html", ".css")


def lookup(files: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (session_id, query): the file of that path, else one whose path ends in it after a slash; exact first, then shortest, then by name.

    Paths are expanded to all their ends at a slash, so the lookup is an equi-join.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = files.select("session_id", "path", F.explode(ends).alias("query"))
    hit = queries.join(keys, ["session_id", "query"])
    best = F.min(F.struct((F.col("path") != F.col("query")).alias("part"), F.char_length("path").alias("size"), "path")).alias("b")
    return hit.groupBy("session_id", "query").agg(best, F.count("*").alias("candidates")).select("session_id", "query", "b.path", "candidates")


def line_slice(files: DataFrame, first: int, last: int) -> DataFrame:
    """Numbered lines first to last of each file, clamped."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    at = F.greatest(F.lit(1), F.lit(first))
    upto = F.least(F.size(lines), F.lit(last))
    part = F.slice(lines, at, F.greatest(upto - at + 1, F.lit(0)))
    text = F.array_join(F.transform(part, lambda x, i: F.concat((i + at).cast("string"), F.lit(": "), x)), "\n")
    return files.select("session_id", "path", F.size(lines).cast("long").alias("line_count"), F.size(part).cast("long").alias("lines"), text.alias("text"))


def outline(files: DataFrame) -> DataFrame:
    """Lines that define a function, class, constant or heading: (session_id, path, line, kind, name)."""
    rules = (("function", r"^\s*(?:async\s+)?(?:def|function|fn|func)\s+(\w+)"), ("class", r"^\s*(?:class|struct|interface|enum)\s+(\w+)"), ("const", r"^\s*(?:const|let|var)\s+(\w+)"), ("heading", r"<h[1-6][^>]*>([^<]+)<"))
    rows = files.select("session_id", "path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    name = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("name")) for k, p in rules])
    rows = rows.select("session_id", "path", (F.col("at") + 1).cast("long").alias("line"), F.get(F.filter(name, lambda x: x["name"] != ""), F.lit(0)).alias("hit")).where("hit is not null")
    return rows.select("session_id", "path", "line", "hit.kind", "hit.name")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """File contents (session_id, path, content, turn) after new ones came in: the same content changes nothing, else the latest wins."""
    keyed = lambda d, n: d.select("session_id", "path", "content", "turn", F.lit(n).alias("new"))
    latest = F.max_by(F.struct("content", "turn"), F.struct("new", "turn"))
    kept = F.max_by(F.when(F.col("new") == 0, F.struct("content", "turn")), F.when(F.col("new") == 0, F.col("turn")))
    out = keyed(old, 0).union(keyed(new, 1)).groupBy("session_id", "path").agg(latest.alias("l"), kept.alias("k"))
    v = F.when(F.sha2(F.col("k.content"), 256) == F.sha2(F.col("l.content"), 256), F.col("k")).otherwise(F.col("l"))
    return out.withColumn("v", v).select("session_id", "path", "v.content", "v.turn", F.size(F.split("v.content", "\n")).cast("long").alias("line_count"))


def evicted(files: DataFrame, ttl: int = 50, most: int = 200) -> DataFrame:
    """Files that stay: not older than ttl turns before the session's newest, and the newest `most` of these."""
    newest = F.max("last_updated_turn").over(Window.partitionBy("session_id"))
    rows = files.withColumn("_n", newest).where((F.col("_n") - ttl <= 0) | (F.col("last_updated_turn") >= F.col("_n") - ttl))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last_updated_turn"), "path"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_n", "_r")


def references(files: DataFrame) -> DataFrame:
    """(session_id, path, target) for each reference that a file's content makes."""
    return files.select("session_id", "path", F.explode(T.references(F.col("content"))).alias("target"))


def resolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (session_id, src, dst): a reference resolves to the path itself, with an extension, as an index, else to the file of that base name; never to its own file."""
    bare = F.regexp_replace("target", r"^(?:https?://|\./|/)+", "")
    ways = [F.struct(F.lit(0).alias("p"), bare.alias("key"))] + [F.struct(F.lit(1).alias("p"), F.concat(bare, F.lit(e)).alias("key")) for e in EXTENSIONS]
    ways += [F.struct(F.lit(2).alias("p"), F.concat(bare, F.lit("/index"), F.lit(e)).alias("key")) for e in EXTENSIONS] + [F.struct(F.lit(3).alias("p"), F.concat(F.lit("base:"), F.regexp_extract(bare, r"([^/]+?)/?$", 1)).alias("key"))]
    asked = refs.select("session_id", F.col("path").alias("src"), "target", F.explode(F.array(*ways)).alias("w")).select("session_id", "src", "target", "w.p", "w.key")
    full = files.select("session_id", F.col("path").alias("dst"), F.col("path").alias("key"))
    base = files.select("session_id", F.col("path").alias("dst"), F.concat(F.lit("base:"), F.regexp_extract("path", r"([^/]+?)/?$", 1)).alias("key"))
    hit = asked.join(full.union(base), ["session_id", "key"]).where("src <> dst")
    best = hit.groupBy("session_id", "src", "target").agg(F.min(F.struct("p", "dst")).alias("b"))
    return best.select("session_id", "src", F.col("b.dst").alias("dst")).distinct()


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many others refer to each node (session_id, path), none included."""
    n = edges.groupBy("session_id", F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    return nodes.join(n, ["session_id", "path"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def dependency_order(degrees: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(F.desc("in_degree"), "path")
    return degrees.withColumn("rank", F.row_number().over(order).cast("long"))


def recurring(files: DataFrame, least: int = 3) -> DataFrame:
    """File endings that at least so many directories have."""
    end = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    parent = F.regexp_replace("path", "/[^/]*$", "")
    rows = files.select("session_id", end.alias("pattern"), parent.alias("parent")).where("pattern <> ''")
    return rows.groupBy("session_id", "pattern").agg(F.count_distinct("parent").alias("parents"), F.count("*").alias("files")).where(F.col("parents") >= least)


def relevance(files: DataFrame, query: str) -> DataFrame:
    """Relevance of each file to a query, and its rank in its session."""
    own = T.keyword_relevance(F.lit(query), F.concat_ws("\n", "path", "content"))
    order = Window.partitionBy("session_id").orderBy(F.desc("relevance"), "path")
    return files.select("session_id", "path", own.alias("relevance")).withColumn("rank", F.row_number().over(order).cast("long"))


def retrieval_ranked(files: DataFrame, query: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Files (session_id, path, content, reason, pos) by the weighted sum of recency, which is 1 within one briefing, importance and relevance; ties keep their order."""
    recent, important, relevant = weights
    own = F.lit(float(recent)) + T.importance(F.col("reason")) * important + T.keyword_relevance(F.lit(query), F.concat_ws("\n", "path", "content")) * relevant
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "pos")
    return files.select("session_id", "path", "pos", own.alias("score")).withColumn("rank", F.row_number().over(order).cast("long")).drop("pos")


def first_seen(lists: DataFrame) -> DataFrame:
    """Ordered union of lists of files (session_id, turn, paths): each path where it comes first."""
    rows = lists.select("session_id", "turn", F.posexplode("paths").alias("pos", "path"))
    first = rows.groupBy("session_id", "path").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return first.select("session_id", "path", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).cast("long").alias("rank"))


def combined_order(a: DataFrame, b: DataFrame, examples: tuple[str, ...] = ()) -> DataFrame:
    """Two rankings (session_id, path, rank) taken in turns, each file where it comes first; before all others the first of the first ranking that ends like an example."""
    both = a.select("session_id", "path", (F.col("rank") * 2).alias("r")).union(b.select("session_id", "path", (F.col("rank") * 2 + 1).alias("r")))
    if examples:
        like = reduce(lambda x, y: x | y, [F.col("path").endswith(e) for e in examples])
        both = both.union(a.where(like).groupBy("session_id").agg(F.min_by("path", "rank").alias("path")).select("session_id", "path", F.lit(0).alias("r")))
    first = both.groupBy("session_id", "path").agg(F.min("r").alias("r"))
    return first.select("session_id", "path", F.row_number().over(Window.partitionBy("session_id").orderBy("r", "path")).cast("long").alias("rank"))


def propagated(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """A file's score with those of the files that refer to it."""
    add = edges.join(scores.withColumnRenamed("path", "src"), ["session_id", "src"]).groupBy("session_id", F.col("dst").alias("path")).agg(F.sum("score").alias("more"))
    return scores.join(add, ["session_id", "path"], "left").select("session_id", "path", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def touches(events: DataFrame) -> DataFrame:
    """State of each file after its touches (session_id, path, status, turn): latest status, last read and last modified turn."""
    turn = lambda *s: F.max(F.when(F.col("status").isin(*s), F.col("turn")))
    return events.groupBy("session_id", "path").agg(F.max_by("status", "turn").alias("status"), turn("read").alias("last_read_turn"), F.coalesce(turn("modified", "created"), F.lit(0)).alias("last_modified_turn"), F.count("*").alias("touches"))


def union(cached: DataFrame, seen: DataFrame) -> DataFrame:
    """Cached files and files that traces saw (session_id, path, turn), with the later turn."""
    both = cached.select("session_id", "path", F.col("last_updated_turn").alias("c")).join(seen.select("session_id", "path", F.col("turn").alias("t")), ["session_id", "path"], "full")
    return both.select("session_id", "path", F.greatest("c", "t").alias("turn"), F.col("c").isNotNull().alias("cached"))


def code_map(degrees: DataFrame, edges: DataFrame, foundations: int = 8, out: int = 6) -> DataFrame:
    """One text per session: its most referred-to files, and up to so many targets of each file."""
    top = dependency_order(degrees).where(F.col("rank") <= foundations)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "in_degree"))), lambda x: F.concat(x["path"], F.lit(" ("), x["in_degree"].cast("string"), F.lit(")"))), "; ")
    base = top.groupBy("session_id").agg(lines.alias("foundations"))
    rank = F.row_number().over(Window.partitionBy("session_id", "src").orderBy("dst"))
    few = edges.withColumn("r", rank).where(F.col("r") <= out).groupBy("session_id").agg(F.count("*").alias("edges"))
    return base.join(few, "session_id", "left").select("session_id", "foundations", F.coalesce("edges", F.lit(0)).alias("edges"))


def _capped(text: Column, most: int) -> Column:
    """A text within a number of characters, cut at its last line end, with a mark behind it."""
    head = F.substring(text, 1, most)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head), F.lit("\n... [map truncated]")))


def _foundations(degrees: DataFrame, most: int) -> DataFrame:
    """(session_id, foundations): the files that most others refer to, with how many do."""
    order = Window.partitionBy("session_id").orderBy(F.desc("in_degree"), "path")
    top = degrees.where("in_degree > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    line = F.concat("path", F.lit(" (<-"), F.col("in_degree").cast("string"), F.lit(")"))
    return top.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda s: s["x"]), ", ").alias("foundations"))


def rendered_map(degrees: DataFrame, edges: DataFrame, foundations: int = 8, out: int = 6, most: int = 1600) -> DataFrame:
    """(session_id, map): what a session's files (session_id, path, in_degree) rest on, and what each refers to by its edges (session_id, src, dst), those that most others refer to first; sessions without edges have none."""
    by = Window.partitionBy("session_id", "src").orderBy("dst")
    few = edges.distinct().withColumns({"k": F.row_number().over(by), "n": F.count("*").over(Window.partitionBy("session_id", "src"))}).where(F.col("k") <= out)
    few = few.groupBy("session_id", F.col("src").alias("path"), "n").agg(F.array_join(F.array_sort(F.collect_list("dst")), ", ").alias("to"))
    line = F.concat("path", F.lit(" -> "), "to", F.when(F.col("n") > out, F.concat(F.lit(", +"), (F.col("n") - out).cast("string"), F.lit(" more"))).otherwise(""))
    lines = few.join(degrees, ["session_id", "path"]).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("in_degree")).alias("d"), "path", line.alias("x")))), lambda s: s["x"]), "\n").alias("lines"))
    text = F.concat_ws("\n", F.lit("=== CODE MAP ==="), F.concat(F.lit("Load-bearing: "), F.col("foundations")), "lines")
    return lines.join(_foundations(degrees, foundations), "session_id", "left").select("session_id", _capped(text, most).alias("map"))


def rendered_task_map(ranked: DataFrame, degrees: DataFrame, examples: tuple[str, ...] = (), shown: int = 6, foundations: int = 6, most: int = 1600) -> DataFrame:
    """(session_id, map): the files that suit a task best (session_id, path, rank), examples marked, and what all rest on."""
    like = reduce(lambda x, y: x | y, [F.col("path").endswith(e) for e in examples], F.lit(False))
    line = F.concat(F.lit("  "), "path", F.when(like, " [exemplar]").otherwise(""))
    first = ranked.where(F.col("rank") <= shown).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda s: s["x"]), "\n").alias("lines"))
    text = F.concat_ws("\n", F.lit("=== CODE MAP (task-ranked) ===\nSTART HERE (most relevant to this task):"), "lines", F.concat(F.lit("Shared foundations: "), F.col("foundations")))
    return first.join(_foundations(degrees, foundations), "session_id", "left").select("session_id", _capped(text, most).alias("map"))


def activity_scores(files: DataFrame, query: str, shown: int = 3) -> DataFrame:
    """(session_id, path, score, rank) of files (session_id, path, outline, last_updated_turn): 2 for each word of the query in the path, 1.5 for each in the outline, and half the last turn, 3 at most.

    Words have three letters or more. Files without a score are shown among the first `shown` only.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"\W+"), lambda w: F.char_length(w) > 2))
    hits = lambda c: F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w)))
    turn = F.coalesce("last_updated_turn", F.lit(0))
    score = hits(F.col("path")) * 2.0 + hits(F.col("outline")) * 1.5 + F.when(turn > 0, F.least(F.lit(3.0), turn * 0.5)).otherwise(0.0)
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "path")
    rows = files.select("session_id", "path", score.alias("score")).withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where((F.col("score") > 0) | (F.col("rank") <= shown))
