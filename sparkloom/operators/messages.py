"""Conversations as ordered rows: turns, tails, previews, accounting, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import asking
from ..functions import text as T
from ..functions.phrasing import sanitised_system


def _order(session: str = "session_id"):
    return Window.partitionBy(session).orderBy("idx")


def turns(messages: DataFrame) -> DataFrame:
    """Turn of each message: how many user messages there were up to it."""
    return messages.withColumn("turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(_order().rowsBetween(Window.unboundedPreceding, 0)))


def turn_inventory(messages: DataFrame, user: int = 80, assistant: int = 60) -> DataFrame:
    """First user and assistant previews of each turn."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("idx")))
    out = turns(messages).where("turn > 0").groupBy("session_id", "turn").agg(first("user").alias("u"), first("assistant").alias("a"), F.count("*").alias("messages"))
    return out.select("session_id", "turn", F.substring("u", 1, user).alias("user_preview"), F.substring("a", 1, assistant).alias("assistant_preview"), "messages")


def boundaries(messages: DataFrame) -> DataFrame:
    """Whether a message starts a turn, and whether its session ends with a user."""
    last = F.max_by("role", "idx").over(Window.partitionBy("session_id"))
    return messages.select("session_id", "idx", (F.col("role") == "user").alias("boundary"), (last == "user").alias("open"))


def turn_records(traces: DataFrame) -> DataFrame:
    """Traces (session_id, turn_number, messages of (role, content), response, output_tokens, upstream_ms, assembly_ms) as records of turns, numbered as they come, with the head of the last user message."""
    said = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"]
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_number"))
    last = F.when(F.size(F.filter(F.coalesce("messages", F.array().cast(dict(traces.dtypes)["messages"])), lambda m: m["role"] == "user")) > 0, said)
    latency = F.coalesce(F.nullif("upstream_ms", F.lit(0.0)), "assembly_ms")
    return traces.select("session_id", turn.cast("long").alias("turn"), F.substring(F.coalesce(last, F.lit("")), 1, 500).alias("user_msg"), F.coalesce("response", F.lit("")).alias("response"), "output_tokens", latency.alias("latency_ms"))


def finished(requests: DataFrame) -> DataFrame:
    """Requests (request_id, last_role, finish_reason) at which a turn ends or begins: the last message is a user's, or the answer stopped by itself."""
    return requests.select("request_id", ((F.col("last_role") == "user") | F.coalesce(F.col("finish_reason") == "stop", F.lit(False))).alias("boundary"))


def bounded(messages: DataFrame, most: int = 2000) -> DataFrame:
    """Messages as traces keep them: contents, texts of parts (type, text) and arguments of calls cut to `most` characters, with a mark of how long they were."""
    cut = lambda c: F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("... ["), F.char_length(c).cast("string"), F.lit(" chars truncated]"))).otherwise(c)
    out = messages.withColumn("content", cut(F.col("content")))
    if "parts" in messages.columns:
        out = out.withColumn("parts", F.transform("parts", lambda p: p.withField("text", cut(p["text"]))))
    if "tool_calls" in messages.columns:
        out = out.withColumn("tool_calls", F.transform("tool_calls", lambda t: t.withField("function", t["function"].withField("arguments", cut(t["function"]["arguments"])))))
    return out


def coherence_tail(messages: DataFrame, base: int = 5, most: int = 20) -> DataFrame:
    """The last `base` messages; for sessions with tool results (tool_call_id), moved back until each result has its call, up to `most` messages, else to the first user message within these.

    A result's call is the latest earlier assistant message that holds its id, so the tail starts at the smallest call place among results
    that follow the start; calls found this way lie before the start and bring in no result that they don't hold, so a running minimum finds the fixed point.
    """
    n = F.count("*").over(Window.partitionBy("session_id"))
    place = F.row_number().over(_order()) - 1
    rows = messages.withColumn("n", n).withColumn("at", place)
    if "tool_call_id" not in messages.columns:
        return rows.where(F.col("at") >= F.col("n") - base).select(*messages.columns)
    calls = rows.where(F.col("role") == "assistant").select("session_id", F.explode("tool_calls").alias("c"), F.col("at").alias("call_at")).select("session_id", F.col("c.id").alias("tool_call_id"), "call_at")
    back = rows.where(F.col("role") == "tool").join(calls, ["session_id", "tool_call_id"], "left").where("call_at is null or call_at < at")
    back = back.groupBy("session_id", "at").agg(F.max("call_at").alias("call_at"))
    rows = rows.join(back, ["session_id", "at"], "left")
    # need(at): the smallest place that any result from `at` on refers to
    need = F.min(F.coalesce("call_at", "at")).over(Window.partitionBy("session_id").orderBy("at").rowsBetween(0, Window.unboundedFollowing))
    closed = rows.withColumn("need", need).withColumn("fits", (F.col("need") >= F.col("at")) & (F.col("at") <= F.greatest(F.col("n") - base, F.lit(0))))
    start = F.max(F.when(F.col("fits"), F.col("at"))).over(Window.partitionBy("session_id"))
    user = F.min(F.when((F.col("role") == "user") & (F.col("at") >= F.col("n") - most), F.col("at"))).over(Window.partitionBy("session_id"))
    closed = closed.withColumn("start", start).withColumn("user_at", user)
    kept = F.when(F.col("n") - F.col("start") <= most, F.col("start")).otherwise(F.coalesce("user_at", F.col("n") - base))
    return closed.where(F.col("at") >= kept).select(*messages.columns)


def last_exchanges(messages: DataFrame, pairs: int = 3) -> DataFrame:
    """Messages from the third last user message on."""
    back = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0))
    own = F.when(F.col("role") == "user", back - 1).otherwise(back)
    return messages.withColumn("_b", own).where(F.col("_b") < pairs).drop("_b")


def merged_roles(messages: DataFrame) -> DataFrame:
    """Neighbouring messages of one role as one."""
    w = _order()
    fresh = F.when(F.col("role").eqNullSafe(F.lag("role").over(w)) & F.lag("idx").over(w).isNotNull(), 0).otherwise(1)
    rows = messages.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("session_id", "_island").agg(F.min("idx").alias("idx"), F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("parts"))
    return out.select("session_id", "idx", "role", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"), F.size("parts").cast("long").alias("merged"))


def fingerprints(messages: DataFrame) -> DataFrame:
    """A session's fingerprint, from its system prompt, without what changes within a session, and its first user message."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("idx")))
    heads = messages.groupBy("session_id").agg(first("system").alias("s"), first("user").alias("u"))
    return heads.select("session_id", T.fingerprint(sanitised_system(F.col("s")), F.col("u")).alias("fingerprint"))


def content_tokens(messages: DataFrame, margin: float = 1.1, least: int = 500, framing: int = 6) -> DataFrame:
    """Token estimates of requests: of contents, the margin on each message and on the sum, and with framing."""
    one = F.greatest(F.floor(T.tokens_by_length(F.col("content")) * F.lit(margin)), F.lit(1)).cast("long")
    out = messages.groupBy("session_id").agg(F.sum(one).alias("s"), F.count("*").alias("messages"))
    total = F.greatest(F.floor(F.col("s") * F.lit(margin)).cast("long"), F.lit(least).cast("long"))
    return out.select("session_id", "messages", total.alias("content_tokens"), (F.col("s") + framing * F.col("messages")).alias("structural_tokens"))


def request_prefixes(messages: DataFrame) -> DataFrame:
    """The request before each assistant message: its length and characters, where it ends in a user or tool message."""
    w = _order()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select("session_id", "idx", "role", F.count("*").over(before).alias("messages"), F.sum(F.char_length("content")).over(before).alias("chars"), F.lag("role").over(w).alias("last_role"))
    return rows.where((F.col("role") == "assistant") & F.col("last_role").isin("user", "tool")).select("session_id", "idx", "messages", "chars", "last_role")


def selected_turns(messages: DataFrame, selection: DataFrame, tail: int = 4) -> DataFrame:
    """Messages of the turns that selection (session_id, turns) names, and the tail; a null list keeps all turns, an empty one none."""
    n = F.max("idx").over(Window.partitionBy("session_id"))
    rows = turns(messages).withColumn("_last", n).join(selection, "session_id", "left")
    keep = F.col("turns").isNull() | F.array_contains("turns", F.col("turn")) | (F.col("idx") > F.col("_last") - tail) | (F.col("role") == "system")
    return rows.where(keep).select(*messages.columns, "turn")


def intents(messages: DataFrame) -> DataFrame:
    """Intent of each user message, and whether it differs from the one before."""
    own = asking.kind(F.col("content"))
    users = messages.where(F.col("role") == "user").select("session_id", "idx", own.alias("intent"))
    return users.withColumn("shift", F.coalesce(F.col("intent") != F.lag("intent").over(_order()), F.lit(False)))


def previews(messages: DataFrame, limit: int = 400) -> DataFrame:
    return messages.select("session_id", "idx", T.preview(F.coalesce("content", F.lit("")), limit).alias("preview"))


def tail_of_results(messages: DataFrame, budget: int = 4000) -> DataFrame:
    """The newest messages within a number of characters, the oldest of these cut, in order."""
    back = Window.partitionBy("session_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length(F.coalesce("content", F.lit("")))
    rows = messages.withColumn("_used", F.coalesce(F.sum(size).over(back), F.lit(0))).where(F.col("_used") < budget)
    return rows.select("session_id", "idx", "role", F.substring("content", F.lit(1), (F.lit(budget) - F.col("_used")).cast("int")).alias("content"))


def compression_priority(messages: DataFrame) -> DataFrame:
    """How late a message is compressed: by role and place; system prompts last."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    place = F.row_number().over(_order()) - 1
    rank = F.element_at(F.create_map(F.lit("tool"), F.lit(2), F.lit("assistant"), F.lit(1), F.lit("user"), F.lit(0)), F.col("role"))
    share: Column = F.coalesce(F.try_divide(place.cast("double"), (n - 1).cast("double")), F.lit(0.0))
    own = F.when(F.col("role") == "system", 1000.0).otherwise((F.lit(2.0) - F.coalesce(rank, F.lit(2))) / 2.0 + 0.4 * share)
    return messages.select("session_id", "idx", "role", own.alias("priority"))
