"""Briefings from a log of tools, their kept form, and trace fields that several steps of a turn set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a file is there for where no score says so; fixed value.
RETRIEVED = "retrieved by curator"
#: Fields of a briefing, their types, and what older versions that lack them stand for.
FIELDS = {
    "session_id": ("string", None), "source_turn": ("bigint", 0), "timestamp": ("double", 0.0), "checkpoint_text": ("string", ""), "open_issues_text": ("string", ""), "last_verification_text": ("string", ""),
    "decisions_text": ("string", ""), "session_goal": ("string", ""), "facts_text": ("string", ""), "files": ("array<struct<path: string, outline: string, relevance: string>>", "[]"), "retained_turns": ("array<bigint>", None),
    "turn_inventory": ("string", ""), "context_block": ("string", ""), "mode": ("string", "two_pass"), "tool_calls_used": ("bigint", 0), "iterations_used": ("bigint", 0), "latency_ms": ("double", 0.0),
}
#: Trace fields of which zero says nothing, and the characters that others are cut to; fixed values.
COUNTED = ["extractor_prompt_tokens", "extractor_completion_tokens", "extractor_llm_calls", "extractor_cached_tokens", "curator_prompt_tokens", "curator_completion_tokens", "curator_cached_tokens", "embedding_tokens"]
CUT = {"upstream_response_summary": 500, "recall_question": 200}


def ranges(log: DataFrame) -> DataFrame:
    """(session_id, path, first, last, content): the lines of each file that a log (session_id, pos, path, first, result) of excerpts shows, ranges that overlap or touch as one.

    An excerpt is its result's lines, numbered from `first`. Of a line that several show the latest holds. Lines are counted, and joined again by their numbers, so no excerpt is compared with another.
    """
    lines = log.select("session_id", "path", "pos", F.col("first").cast("long").alias("from"), F.posexplode(F.split(F.coalesce("result", F.lit("")), "\n")).alias("i", "text"))
    lines = lines.groupBy("session_id", "path", (F.col("from") + F.col("i")).alias("line")).agg(F.max_by("text", "pos").alias("text"))
    order = Window.partitionBy("session_id", "path").orderBy("line")
    lines = lines.withColumn("run", F.col("line") - F.row_number().over(order))  # the same for lines that follow each other
    out = lines.groupBy("session_id", "path", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
    return out.select("session_id", "path", "first", "last", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("content"))


def scores(log: DataFrame) -> DataFrame:
    """(session_id, path, reason) from results of scoring: rows `score | path | reason` of their tables, the last of each path; a row without a reason has its score."""
    parts = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = log.select("session_id", "pos", F.posexplode(F.split(F.coalesce("result", F.lit("")), "\n")).alias("at", "line")).withColumn("p", parts).where("size(p) >= 2")
    rows = rows.select("session_id", "pos", "at", F.get("p", F.lit(0)).try_cast("double").alias("score"), F.get("p", F.lit(1)).alias("path"), F.get("p", F.lit(2)).alias("said"))
    rows = rows.where("score is not null and path <> '' and path not in ('Path', '---')")
    reason = F.coalesce("said", F.concat(F.lit("score "), F.format_string("%.1f", "score")))
    return rows.groupBy("session_id", "path").agg(F.max_by(reason, F.struct("pos", "at")).alias("reason"))


def briefed_files(log: DataFrame) -> DataFrame:
    """(session_id, path, outline, relevance, sections) of what a tool log (session_id, pos, tool, status, path, first, result) has read; only calls with status ok count.

    Tools: get_file and get_file_lines (an excerpt from line `first`, 1 without one), get_file_outline (the last holds), score_file_relevance (see scores). Sections are merged ranges in order.
    """
    done = log.where("status = 'ok'")
    reads = done.where(F.col("tool").isin("get_file", "get_file_lines") & (F.coalesce("path", F.lit("")) != "")).withColumn("first", F.greatest(F.coalesce("first", F.lit(1)), F.lit(1)))
    part = ranges(reads).groupBy("session_id", "path").agg(F.array_sort(F.collect_list(F.struct("first", "last", "content"))).alias("sections"))
    outlines = done.where("tool = 'get_file_outline' and path <> ''").groupBy("session_id", "path").agg(F.max_by(F.coalesce("result", F.lit("")), "pos").alias("outline"))
    why = scores(done.where("tool = 'score_file_relevance'"))
    out = part.join(outlines, ["session_id", "path"], "left").join(why, ["session_id", "path"], "left")
    return out.select("session_id", "path", F.coalesce("outline", F.lit("")).alias("outline"), F.coalesce("reason", F.lit(RETRIEVED)).alias("relevance"), "sections")


def kept(rows: DataFrame, version: int = 2, rest: str | None = None) -> DataFrame:
    """(session_id, version, body): briefings as values of their own kind, fields that a row lacks left out; `rest` names a column of further fields (map of variants), as opened() gives them."""
    own = [c for c in FIELDS if c in rows.columns]
    value = lambda c: F.to_variant_object(c) if FIELDS[c][0].startswith("array") else F.col(c).cast("variant")
    known = F.create_map(*[x for c in own for x in (F.lit(c), value(c))])
    known = F.map_filter(known, lambda _, v: v.isNotNull())
    body = F.map_concat(F.map_filter(F.coalesce(F.col(rest), known), lambda k, _: ~k.isin(*FIELDS)), known) if rest else known
    return rows.select("session_id", F.lit(version).alias("version"), F.to_variant_object(body).alias("body"))


def opened(stored: DataFrame) -> DataFrame:
    """All fields of kept briefings, of any version: what one lacks has its default, and fields that aren't known are in `rest`."""
    get = lambda name, kind: F.try_variant_get("body", f"$.{name}", kind)
    fields = []
    for name, (kind, default) in FIELDS.items():
        value = get(name, kind)
        if default == "[]":
            value = F.coalesce(value, F.array().cast(kind))
        elif default is not None:
            value = F.coalesce(value, F.lit(default).cast(kind))
        fields.append(value.alias(name))
    rest = F.map_filter(F.col("body").cast("map<string, variant>"), lambda k, _: ~k.isin(*FIELDS))
    return stored.select("version", *fields, rest.alias("rest"))


def merged_fields(events: DataFrame) -> DataFrame:
    """(turn_id, name, value): each field of a turn's trace as its setters (turn_id, pos, name, value) leave it: the last holds, but of counts the last that isn't zero; texts are cut.

    Repeated events change nothing, nor does the order in which they arrive. A recall that was used without a trigger was the model's own.
    """
    counts = F.col("name").isin(*COUNTED) & (F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) == 0)
    last = events.where(~counts).groupBy("turn_id", "name").agg(F.max_by(F.struct("value"), F.struct("pos", "value"))["value"].alias("value"))
    size = F.lit(None)
    for name, n in CUT.items():
        size = F.when(F.col("name") == name, n).otherwise(size)
    cut = last.withColumn("value", F.when(size.isNotNull(), F.substring(F.col("value"), F.lit(1), size.cast("int"))).otherwise(F.col("value")))
    flag = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    own = cut.groupBy("turn_id").agg(flag("recall_used").alias("used"), flag("recall_trigger").alias("trigger")).where("used = 'true' and coalesce(trigger, '') = ''")
    return cut.where("name <> 'recall_trigger' or value <> ''").union(own.select("turn_id", F.lit("recall_trigger"), F.lit("model_invoked")))

