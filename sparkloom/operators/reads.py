"""Tool activity: call and result joins, redundancy of reads, repeats and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.content import path_argument

READ_TOOLS = ("read", "read_file", "view", "cat")
WRITE_TOOLS = ("write", "write_file", "create_file")


def tool_results(messages: DataFrame) -> DataFrame:
    """Results with the call that they answer (name, path); of calls with one id the later counts."""
    call = F.explode("tool_calls").alias("c")
    calls = messages.where(F.col("role") == "assistant").select("session_id", "idx", call)
    calls = calls.groupBy("session_id", F.col("c.id").alias("tool_call_id")).agg(F.max_by(F.struct(F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"), F.col("idx").alias("call_idx")), "idx").alias("call"))
    results = messages.where((F.col("role") == "tool") & (F.trim(F.coalesce("content", F.lit(""))) != "")).select("session_id", "idx", "tool_call_id", "content")
    return results.join(calls, ["session_id", "tool_call_id"]).select("session_id", "idx", "tool_call_id", "call.name", path_argument(F.col("call.arguments")).alias("path"), "call.call_idx", "content")


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (session_id, call_id, tool, path) with their results (session_id, call_id, content), blank ones left out."""
    return calls.join(results.where(F.trim("content") != ""), ["session_id", "call_id"])


def classified(activity: DataFrame) -> DataFrame:
    """Reads as exact duplicates of an earlier read's content, superseded by a later full write of their path, or live; a duplicate counts as such first."""
    reads = activity.where(F.col("tool").isin(*READ_TOOLS) & (F.col("content") != ""))
    again = F.row_number().over(Window.partitionBy("session_id", "content").orderBy("idx")) > 1
    writes = activity.where(F.col("tool").isin(*WRITE_TOOLS)).groupBy("session_id", "path").agg(F.max("idx").alias("written"))
    rows = reads.withColumn("again", again).join(writes, ["session_id", "path"], "left")
    bucket = F.when(F.col("again"), "exact_dup").when(F.coalesce(F.col("written") > F.col("idx"), F.lit(False)), "superseded").otherwise("live")
    return rows.select("session_id", "idx", "path", bucket.alias("bucket"), T.tokens_by_length(F.col("content")).alias("tokens"))


def redundancy(activity: DataFrame) -> DataFrame:
    """Reads and tokens of each class per session, and their shares (0 without reads)."""
    rows = classified(activity)
    names = ["exact_dup", "superseded", "live"]
    sums = [F.sum(F.when(F.col("bucket") == b, F.col("tokens")).otherwise(0)).alias(f"{b}_tokens") for b in names]
    out = rows.groupBy("session_id").agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens"), *[F.count_if(F.col("bucket") == b).alias(f"{b}_reads") for b in names], *sums)
    return out.withColumns({f"{b}_ratio": F.coalesce(F.try_divide(F.col(f"{b}_tokens").cast("double"), F.col("tokens").cast("double")), F.lit(0.0)) for b in names})


def repeated(activity: DataFrame, last: int = 20, most: int = 3) -> DataFrame:
    """Among a session's last activities, what was read more than once; the most frequent first."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("idx")))
    recent = activity.withColumn("_b", back).where(F.col("_b") <= last).where(F.col("tool").isin(*READ_TOOLS))
    by = recent.groupBy("session_id", "content").agg(F.count("*").alias("times")).where("times >= 2")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("times"), "content"))
    return by.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def stuck(activity: DataFrame, failed: str, last: int = 3) -> DataFrame:
    """Places where the last so many outcomes all failed with one tool."""
    w = Window.partitionBy("session_id").orderBy("idx").rowsBetween(-(last - 1), 0)
    rows = activity.withColumn("bad", F.sum(F.col(failed).cast("int")).over(w)).withColumn("low", F.min("tool").over(w)).withColumn("high", F.max("tool").over(w))
    return rows.where((F.col("bad") == last) & (F.col("low") == F.col("high"))).select("session_id", "idx", "tool")


def repeats(activity: DataFrame) -> DataFrame:
    """Whether an activity repeats an earlier one with the same tool and path."""
    n = F.row_number().over(Window.partitionBy("session_id", "tool", "path").orderBy("idx"))
    return activity.select("session_id", "idx", "tool", "path", (n > 1).alias("repeat"))


def tool_families(activity: DataFrame, registry: DataFrame, default: str = "default") -> DataFrame:
    """The extractor of each tool: its own, else the longest registered prefix, else the default. registry: (prefix, extractor), a small fixed table."""
    tools = activity.groupBy("tool").agg(F.count("*").alias("calls"))
    hit = tools.join(F.broadcast(registry), F.col("tool").startswith(F.col("prefix")), "left")
    best = hit.groupBy("tool", "calls").agg(F.max_by("extractor", F.char_length("prefix")).alias("extractor"))
    return best.select("tool", "calls", F.coalesce("extractor", F.lit(default)).alias("extractor"))
