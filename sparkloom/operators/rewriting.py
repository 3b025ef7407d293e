"""Building the context of a request: code within a budget, rewritten conversations, tool results of a turn, issues, search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import messages as messages_


def code_fill(files: DataFrame, budget: int, least: int = 200) -> DataFrame:
    """Files (session_id, path, rank, content) in order of rank while their blocks fit a number of characters; the first that doesn't is cut if more than `least` are left."""
    block = F.concat(F.lit("## "), F.col("path"), F.lit("\n"), F.coalesce("content", F.lit("")))
    w = Window.partitionBy("session_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.withColumn("block", block).withColumn("cost", F.char_length("block") + 1)
    rows = rows.withColumn("left", F.lit(budget) - F.coalesce(F.sum("cost").over(w), F.lit(0)))
    kept = rows.where((F.col("cost") <= F.col("left")) | (F.col("left") > least))
    return kept.select("session_id", "path", "rank", (F.col("cost") > F.col("left")).alias("cut"), F.when(F.col("cost") > F.col("left"), F.substring("block", F.lit(1), F.col("left").cast("int"))).otherwise(F.col("block")).alias("block"))


def rewritten(messages: DataFrame, selection: DataFrame, tail: int = 4, limit: int = 200) -> DataFrame:
    """A conversation with only the selected middle turns and its tail, texts before the tail shortened and reasoning off."""
    rows = messages_.selected_turns(messages, selection, tail)
    old = F.col("idx") <= F.max("idx").over(Window.partitionBy("session_id")) - tail
    body = T.strip_reasoning(F.coalesce("content", F.lit("")))
    return rows.select("session_id", "idx", "role", F.when(old & (F.col("role") != "system"), T.preview(body, limit)).otherwise(body).alias("content"))


def current_turn(messages: DataFrame) -> DataFrame:
    """Messages of the turn that is under way: after the last user message; where that is the last message, those between it and the user message before."""
    w = Window.partitionBy("session_id")
    users = F.when(F.col("role") == "user", F.col("idx"))
    rows = messages.withColumn("_end", F.max("idx").over(w)).withColumn("_u", F.max(users).over(w))
    before = F.max(F.when((F.col("role") == "user") & (F.col("idx") < F.col("_u")), F.col("idx"))).over(w)
    rows = rows.withColumn("_p", before)
    between = F.when(F.col("_u") == F.col("_end"), (F.col("idx") > F.coalesce("_p", F.lit(-1))) & (F.col("idx") < F.col("_u"))).otherwise(F.col("idx") > F.coalesce("_u", F.lit(-1)))
    return rows.where(between).select(*messages.columns)


def strongest(statuses: DataFrame, order: list[str]) -> DataFrame:
    """The strongest status (session_id, path, status, pos) of each file by an order, weakest first; of equal ones the later."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return statuses.groupBy("session_id", "path").agg(F.max_by("status", F.struct(rank, "pos")).alias("status"))


def resolved_issues(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Issues (session_id, summary, turn) with the turn that a resolution of the very same summary closed them."""
    done = resolutions.groupBy("session_id", "summary").agg(F.min("turn").alias("resolved_turn"))
    return issues.join(done, ["session_id", "summary"], "left").withColumn("open", F.col("resolved_turn").isNull())


def spliced(messages: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Conversations whose message before position `count` has the fingerprint of a cached prefix (session_id, count, fingerprint): what of each can be taken from the cache."""
    mark = messages.select("session_id", F.col("idx"), T.message_fingerprint(F.col("role"), F.col("content")).alias("fingerprint"))
    hit = prefixes.join(mark, (prefixes["session_id"] == mark["session_id"]) & (prefixes["count"] - 1 == mark["idx"]) & (prefixes["fingerprint"] == mark["fingerprint"]), "left")
    return hit.select(prefixes["session_id"], prefixes["count"], F.col("idx").isNotNull().alias("hit"))


def search_hits(files: DataFrame, pattern: str, shown: int = 5, most: int = 10) -> DataFrame:
    """Lines of files that hold a text: how many of each file, the first few, for the first files of a session."""
    lines = files.select("session_id", "path", F.posexplode(F.split("content", "\n")).alias("at", "line")).where(F.contains("line", F.lit(pattern)))
    by = lines.groupBy("session_id", "path").agg(F.count("*").alias("hits"), F.array_sort(F.collect_list((F.col("at") + 1).cast("long"))).alias("at"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("path"))
    return by.withColumn("_r", rank).where(F.col("_r") <= most).select("session_id", "path", "hits", F.array_join(F.transform(F.slice("at", 1, shown), lambda x: x.cast("string")), ",").alias("lines"))


def cached_view(files: DataFrame, most: int = 200, head: int = 10) -> DataFrame:
    """A cached file as it is shown: whole and numbered if short, else its first lines and how many there are."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    part = F.when(F.size(lines) <= most, lines).otherwise(F.slice(lines, 1, head))
    text = F.array_join(F.transform(part, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    return files.select("session_id", "path", F.when(F.size(lines) <= most, text).otherwise(F.concat(text, F.lit("\n... "), F.size(lines).cast("string"), F.lit(" lines"))).alias("view"))
