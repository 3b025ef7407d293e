"""Texts made of rows: context blocks, maps, overviews, event lines, front matter; and listings read back from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T


def closed_fence(block: Column, most: int) -> Column:
    """A block cut to a length; a code fence that is open at the cut is closed."""
    head = F.substring(block, 1, most)
    open_ = (F.size(F.split(head, "```")) - 1) % 2 == 1
    return F.when(F.char_length(block) <= most, block).when(open_, F.concat(head, F.lit("\n```"))).otherwise(head)


def context_blocks(sections: DataFrame) -> DataFrame:
    """Sections (session_id, pos, title, body) of each session as one text; empty ones are left out."""
    kept = sections.where(F.trim(F.coalesce("body", F.lit(""))) != "")
    part = F.concat(F.lit("=== "), F.col("title"), F.lit(" ===\n"), F.col("body"))
    out = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("text")))).alias("all"))
    return out.select("session_id", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("block"), F.size("all").cast("long").alias("sections"))


def task_map(ranked: DataFrame, suffix: str, most: int = 6) -> DataFrame:
    """The files that suit a task best (session_id, path, rank), the first with a given ending marked as the example."""
    kept = ranked.where(F.col("rank") <= most)
    ends = F.col("path").endswith(suffix)
    first = F.min(F.when(ends, F.col("rank"))).over(Window.partitionBy("session_id"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("path"), F.when(ends & (F.col("rank") == first), " [example]").otherwise(""))
    out = kept.withColumn("line", line).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("all"))
    return out.select("session_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("map"))


def overview(files: DataFrame, decisions: DataFrame, files_shown: int = 20, decisions_shown: int = 10) -> DataFrame:
    """First files by path and newest decisions of each session, in one row."""
    few = F.row_number().over(Window.partitionBy("session_id").orderBy("path"))
    a = files.withColumn("_r", few).where(F.col("_r") <= files_shown).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("files"))
    new = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("source_turn"), F.desc("fact_id")))
    b = decisions.withColumn("_r", new).where(F.col("_r") <= decisions_shown).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "fact_id"))), lambda x: x["fact_id"].cast("string")), ",").alias("decisions"))
    return a.join(b, "session_id", "full").select("session_id", F.coalesce("files", F.lit("")).alias("files"), F.coalesce("decisions", F.lit("")).alias("decisions"))


def focus_range(outline: DataFrame, query: str, most: int = 80) -> DataFrame:
    """Of each file's outline (session_id, path, line, name) the entry that suits a query best, and the lines up to the next entry."""
    w = Window.partitionBy("session_id", "path").orderBy("line")
    rows = outline.withColumn("next", F.lead("line").over(w)).withColumn("score", T.keyword_relevance(F.lit(query), F.col("name")))
    best = rows.groupBy("session_id", "path").agg(F.max_by(F.struct("line", "next", "name", "score"), F.struct("score", -F.col("line"))).alias("b"))
    last = F.least(F.coalesce(F.col("b.next") - 1, F.col("b.line") + most - 1), F.col("b.line") + most - 1)
    return best.select("session_id", "path", F.col("b.name").alias("name"), F.col("b.line").alias("first_line"), last.alias("last_line"), F.col("b.score").alias("score"))


def event_line(traces: DataFrame) -> DataFrame:
    """A line to read for each turn."""
    what = F.when(F.col("failed"), "failed").when(F.col("recall_used"), "recalled").otherwise(F.col("assembly_mode"))
    line = F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" #"), F.col("turn_number").cast("string"), F.lit(" "), what, F.lit(" "), F.col("input_tokens").cast("string"), F.lit(" tokens"))
    return traces.select("session_id", "turn_number", line.alias("line"))


def front_matter(facts: DataFrame) -> DataFrame:
    """Facts as documents with a head of key and value lines; quotes and backslashes in values are escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), F.col("fact_type")), F.concat(F.lit("session: "), quoted(F.col("session_id").cast("string"))), F.concat(F.lit("turn: "), F.col("source_turn").cast("string")), F.lit("---"))
    return facts.select("fact_id", F.concat(head, F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("document"))


def write_markdown(facts: DataFrame, path: str) -> None:
    """One text row for each fact, in files under a folder for each type."""
    facts.select("fact_type", "fact_id").join(front_matter(facts), "fact_id").select("fact_type", F.col("document").alias("value")).write.mode("append").partitionBy("fact_type").text(path)


def path_list(c: Column, most: int = 8) -> Column:
    """Struct of the first paths of a listing, how many there are, and how many of them are folders."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.slice(lines, 1, most).alias("paths"), F.size(lines).cast("long").alias("entries"), F.size(F.filter(lines, lambda x: x.endswith("/"))).cast("long").alias("folders"))


def memory_items(c: Column, least: float = 0.5, most: int = 20) -> Column:
    """Memories of an answer: JSON [{content, score}] above a score, or texts between `---` lines or empty lines."""
    rows = F.from_json(c, "array<struct<content: string, score: double>>")
    good = F.filter(rows, lambda r: (F.coalesce(r["score"], F.lit(1.0)) >= least) & (F.trim(F.coalesce(r["content"], F.lit(""))) != ""))
    plain = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n---\n|\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.when(F.ltrim(c).startswith("["), F.transform(good, lambda r: r["content"])).otherwise(plain), 1, most)


def search_results(c: Column, most: int = 5) -> Column:
    """Titles and links of a search tool's JSON, whatever it calls the list: results, web.results, organic_results, or the list itself."""
    kind = "array<struct<title: string, name: string, url: string, link: string>>"
    lists = [F.from_json(F.get_json_object(c, p), kind) for p in ("$.results", "$.web.results", "$.organic_results")] + [F.from_json(F.when(F.ltrim(c).startswith("["), c), kind)]
    found = F.coalesce(*lists, F.array().cast(kind))
    return F.slice(F.transform(found, lambda r: F.struct(F.coalesce(r["title"], r["name"]).alias("title"), F.coalesce(r["url"], r["link"]).alias("url"))), 1, most)


def timing(total: Column, upstream: Column) -> Column:
    """What a request cost besides the call it makes, never below zero, to one decimal."""
    return F.round(F.greatest(F.lit(0.0), total - upstream), 1)
