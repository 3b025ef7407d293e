"""A request's messages made to fit: tails that begin and merge rightly, middles with fewer turns and shorter results, a ceiling on tokens reached in phases.

Messages are rows (session_id, idx, role, content, tool_calls, tool_call_id, name). All steps are windows over a session's rows and joins on its calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.phrasing import already_shown, compressible
from . import messages as messages_

#: Tools whose results tell of something that can be found again; fixed values.
COMPRESSIBLE = [
    "search", "grep", "ripgrep", "find", "findfiles", "web_search", "websearch", "list_directory", "listdir", "ls", "glob", "web_fetch", "webfetch", "fetch", "bash", "shell", "run_command", "execute",
]
#: Characters that are left of a result in the middle; of a result or answer under the ceiling; of a result that had better stay whole. Fixed values.
RESULT, CEILING, PRESERVED = 400, 800, 3000
#: What tokens of contents are taken for, at least, and the margin on them; fixed values.
LEAST, MARGIN = 500, 1.1
#: The weight of a message's place beside that of its turn; a system prompt's priority; fixed values.
PLACE, SYSTEM = 0.4, 1000.0

Tokens = Callable[[Column], Column]


def shortened(c: Column, limit: int, said: str) -> Column:
    """The head of a text, cut at its last line end if that lies in the second half, and how much was left out; said is what stands behind that number."""
    head = F.substring(c, 1, limit)
    back = F.locate("\n", F.reverse(head))
    cut = F.when((back > 0) & (F.char_length(head) - back > limit // 2), F.substring(head, F.lit(1), F.char_length(head) - back)).otherwise(head)
    left = (F.char_length(c) - F.char_length(cut)).cast("string")
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(cut, F.lit("\n[..."), left, F.lit(f" chars {said}...]")))


def _calls(m: str = "tool_calls") -> Column:
    """Whether a message holds tool calls."""
    return F.coalesce(F.size(m) > 0, F.lit(False))


def from_valid_head(tail: DataFrame) -> DataFrame:
    """A tail from its first message on that may come first: a user's, or an assistant's with calls of which one has its result behind it."""
    calls = tail.where((F.col("role") == "assistant") & _calls()).select("session_id", "idx", F.explode("tool_calls").alias("c")).select("session_id", "idx", F.col("c.id").alias("call"))
    results = tail.where("role = 'tool' and tool_call_id is not null").groupBy("session_id", F.col("tool_call_id").alias("call")).agg(F.max("idx").alias("last"))
    answered = calls.join(results, ["session_id", "call"]).where("last > idx").select("session_id", "idx")
    heads = tail.where("role = 'user'").select("session_id", "idx").union(answered).groupBy("session_id").agg(F.min("idx").alias("head"))
    return tail.join(heads, "session_id").where("idx >= head").drop("head")


def merged(messages: DataFrame) -> DataFrame:
    """Neighbouring messages of a user, and of an assistant, as one, with `merged`, how many; a message with calls, or without a content, stays by itself."""
    w = Window.partitionBy("session_id").orderBy("idx")
    alone = ~F.col("role").isin("user", "assistant") | _calls() | F.col("content").isNull()
    rows = messages.withColumn("alone_", F.coalesce(alone, F.lit(True)))
    goes_on = F.col("role").eqNullSafe(F.lag("role").over(w)) & ~F.col("alone_") & ~F.coalesce(F.lag("alone_").over(w), F.lit(True))
    rows = rows.withColumn("run_", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    first = [c for c in messages.columns if c not in ("session_id", "idx", "content")]
    out = rows.groupBy("session_id", "run_").agg(
        F.min("idx").alias("idx"), F.min_by(F.struct(*first), "idx").alias("f"), F.max(F.col("content").isNull()).alias("none"), F.array_sort(F.collect_list(F.struct("idx", F.coalesce("content", F.lit("")).alias("content")))).alias("parts")
    )
    text = F.when(~F.col("none"), F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n"))
    return out.select("session_id", "idx", "f.*", text.alias("content"), F.size("parts").cast("long").alias("merged")).select(*messages.columns, "merged")


def turn_priority(middle: DataFrame, selection: DataFrame) -> DataFrame:
    """middle with `priority`, of which the lowest are shortened first: the rank of its turn in the selection (session_id, turns), most relevant first, and its place; system prompts last.

    Turns are counted within the rows that are given.
    """
    w = Window.partitionBy("session_id").orderBy("idx")
    n = F.count("*").over(Window.partitionBy("session_id"))
    turn = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    rows = middle.withColumns({"turn_": turn.cast("long"), "place_": (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1))}).join(selection.select("session_id", F.col("turns").alias("turns_")), "session_id", "left")
    ranks = F.greatest(F.coalesce(F.size("turns_"), F.lit(0)), F.lit(1))
    at = F.nullif(F.coalesce(F.array_position("turns_", F.col("turn_")), F.lit(0)), F.lit(0))
    relevance = F.coalesce((ranks - at + 1) / ranks, F.lit(0.0))
    return rows.withColumn("priority", F.when(F.col("role") == "system", SYSTEM).otherwise(relevance + PLACE * F.col("place_"))).select(*middle.columns, "priority")


def under_ceiling(messages: DataFrame, ceiling: int, tokens: Tokens = T.tokens_by_length, limits: tuple[int, int] = (CEILING, PRESERVED), least: int = LEAST) -> DataFrame:
    """Messages (with `tail`, and `priority`; name is the tool's) shortened until their tokens are within the ceiling, and `phase`, in which each was shortened, null for others.

    Phase 1 shortens results of compressible tools, phase 2 other long results, less, phase 3 answers; each the lowest priority first. What the session's first system prompt shows already shrinks to a mark. The tail stays.
    Each message is shortened in one phase at most and by a known amount, so one running sum over all phases says where to stop: before the first message at which the ceiling is reached.
    """
    session = Window.partitionBy("session_id")
    c, small, large = F.coalesce("content", F.lit("")), *limits
    size, results = F.char_length(c), ~F.col("tail") & (F.col("role") == "tool")
    seeks = F.coalesce(compressible(F.lower(F.coalesce("name", F.lit(""))), COMPRESSIBLE), F.lit(False))
    phase = F.when(results & seeks & (size > small), 1).when(results & (size > large), 2).when(~F.col("tail") & (F.col("role") == "assistant") & (size > small), 3)
    context = F.coalesce(F.min(F.when(F.col("role") == "system", F.struct("idx", "content"))).over(session)["content"], F.lit(""))
    rows = messages.withColumns({"try_": phase, "context_": context})
    shown = (F.char_length("context_") >= 100) & already_shown(c, F.col("context_"))
    mark = F.concat(F.lit("[content already in session context — "), size.cast("string"), F.lit(" chars: "), F.substring(T.strip(F.substring_index(c, "\n", 1)), 1, 100), F.lit("...]"))
    cut = lambda n: F.when(shown, mark).otherwise(shortened(c, n, "truncated by context ceiling"))
    short = F.when(F.col("try_") == 1, cut(small)).when(F.col("try_") == 2, cut(large)).when(F.col("try_") == 3, T.head_and_tail(c, small))
    rows = rows.withColumn("short_", short)
    rows = rows.withColumn("delta_", F.when(F.col("try_").isNotNull(), ((tokens(F.col("short_")) - tokens(c)) * MARGIN).cast("long")).otherwise(0))
    start = F.greatest(F.floor(F.sum(tokens(c)).over(session) * F.lit(MARGIN)).cast("long"), F.lit(least).cast("long"))
    order = session.orderBy(F.col("try_").asc_nulls_last(), "priority", "idx")
    rows = rows.withColumn("left_", start + F.coalesce(F.sum("delta_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    applied = F.col("try_").isNotNull() & (F.min("left_").over(order.rowsBetween(Window.unboundedPreceding, 0)) > ceiling)
    rows = rows.withColumn("applied_", applied)
    text = F.when(F.col("applied_"), F.col("short_")).otherwise(F.col("content")).alias("content")
    return rows.select(*[text if x == "content" else F.col(x) for x in messages.columns], F.when(F.col("applied_"), F.col("try_")).alias("phase"))


def request(messages: DataFrame, selection: DataFrame, context: DataFrame, base: int = 5, most: int = 20, ceiling: int = 0, tokens: Tokens = T.tokens_by_length, result: int = RESULT, limits: tuple[int, int] = (CEILING, PRESERVED), least: int = LEAST) -> DataFrame:
    """The messages of each session's next request: (session_id, idx, role, content, tail, phase).

    The first system prompt, with the session's context (session_id, context) behind it; of the messages before the tail those whose turn the selection names (null: all), with results of compressible tools shortened and
    answers without reasoning; the tail, from a valid head and merged. All of it under the ceiling, if there is one, and from the first user message on.
    """
    first = messages.where("role = 'system'").groupBy("session_id").agg(F.min("idx").alias("system_"))
    rows = messages.join(first, "session_id", "left").withColumn("prompt_", F.coalesce(F.col("idx") == F.col("system_"), F.lit(False))).drop("system_")
    rest = rows.where("not prompt_").drop("prompt_")
    tail = messages_.coherence_tail(rest, base, most)
    end = merged(from_valid_head(tail)).drop("merged").withColumn("tail", F.lit(True))
    middle = messages_.turns(rest).join(tail.groupBy("session_id").agg(F.min("idx").alias("from_")), "session_id", "left").where("from_ is null or idx < from_").drop("from_")
    middle = middle.join(selection.select("session_id", F.col("turns").alias("turns_")), "session_id", "left").where(F.col("turns_").isNull() | F.array_contains("turns_", F.col("turn"))).drop("turns_", "turn")
    c = F.coalesce("content", F.lit(""))
    seeks = (F.col("role") == "tool") & compressible(F.lower(F.coalesce("name", F.lit(""))), COMPRESSIBLE)
    body = F.when(seeks, shortened(c, result, "— key facts in session context above")).when((F.col("role") == "assistant") & (c != ""), T.strip_reasoning(c)).otherwise(F.col("content"))
    prompt = rows.where("prompt_").drop("prompt_")
    heads = messages.select("session_id").distinct().join(context, "session_id", "left").join(prompt.select("session_id", "idx", "content"), "session_id", "left")
    said = F.coalesce(F.concat(F.col("content"), F.lit("\n\n")), F.lit(""))
    none = {x: F.lit(None).cast(t) for x, t in messages.dtypes if x not in ("session_id", "idx", "role", "content")}
    system = heads.select("session_id", F.coalesce("idx", F.lit(-1)).cast(dict(messages.dtypes)["idx"]).alias("idx"), F.lit("system").alias("role"), F.concat(said, F.coalesce("context", F.lit(""))).alias("content"), *[v.alias(k) for k, v in none.items()])
    before = system.select(*messages.columns).unionByName(middle.withColumn("content", body).select(*messages.columns))
    whole = turn_priority(before.withColumn("tail", F.lit(False)), selection).unionByName(end.select(*messages.columns, "tail").withColumn("priority", F.lit(SYSTEM)))
    whole = under_ceiling(whole, ceiling, tokens, limits, least) if ceiling > 0 else whole.withColumn("phase", F.lit(None).cast("int"))
    user = F.min(F.when(F.col("role") == "user", F.col("idx"))).over(Window.partitionBy("session_id"))
    head = F.min(F.when(F.col("role") == "system", F.col("idx"))).over(Window.partitionBy("session_id"))
    kept = whole.withColumns({"user_": user, "head_": head}).where("idx >= user_ or (role = 'system' and idx = head_)")
    return kept.select("session_id", "idx", "role", "content", "tail", "phase")


def solo(messages: DataFrame, tail: int = 10, shrink: int = 8000, middle: int = 800, least_tokens: int = 30000, strategies: tuple[str, ...] = ("dedup", "shrink", "middle"), tokens: Tokens = T.tokens_by_length) -> DataFrame:
    """Messages of sessions that work without a user, made shorter by the strategies named: (messages' columns, strategy, saved), saved in characters.

    dedup: a result that the session has had before becomes a mark; shrink: other results are cut to `shrink` characters; middle: answers before the last `tail` messages keep head and tail. Each message falls to the
    first that fits, sessions below least_tokens to none.
    """
    session = Window.partitionBy("session_id")
    c = F.coalesce("content", F.lit(""))
    again = F.row_number().over(Window.partitionBy("session_id", "role", F.sha2(c, 256)).orderBy("idx")) > 1
    late = F.row_number().over(session.orderBy(F.desc("idx"))) <= tail
    rows = messages.withColumns({"again_": again, "late_": late, "enough_": F.sum(tokens(c)).over(session) >= least_tokens})
    mark = F.concat(F.lit("[same result as before: "), F.char_length(c).cast("string"), F.lit(" chars]"))
    ways = {
        "dedup": (F.col("role") == "tool") & F.col("again_") & (F.char_length(c) > F.char_length(mark)), "shrink": (F.col("role") == "tool") & (F.char_length(c) > shrink),
        "middle": (F.col("role") == "assistant") & ~F.col("late_") & (F.char_length(c) > middle),
    }
    texts = {"dedup": mark, "shrink": shortened(c, shrink, "shrunk"), "middle": T.head_and_tail(c, middle)}
    strategy, text = F, F
    for name in strategies:
        strategy, text = strategy.when(F.col("enough_") & ways[name], name), text.when(F.col("strategy") == name, texts[name])
    rows = rows.withColumn("strategy", strategy).withColumn("text_", text.otherwise(F.col("content")))
    saved = F.when(F.col("strategy").isNotNull(), F.char_length(c) - F.char_length("text_")).otherwise(0).cast("long")
    return rows.select(*[F.col("text_").alias(x) if x == "content" else F.col(x) for x in messages.columns], "strategy", saved.alias("saved"), "enough_")


def solo_statistics(shortened_: DataFrame, least_tokens: int = 30000) -> DataFrame:
    """(session_id, strategies, saved by each and in all, skipped): what solo() did to each session, and why nothing."""
    saved = lambda n: F.coalesce(F.sum(F.when(F.col("strategy") == n, F.col("saved"))), F.lit(0)).alias(f"saved_{n}")
    out = shortened_.groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"), saved("dedup"), saved("shrink"), saved("middle"), F.sum("saved").alias("saved"), F.max("enough_").alias("enough_")
    )
    reason = F.when(~F.col("enough_"), f"below_threshold_{least_tokens}").when(F.col("strategies") == "", "nothing_to_shorten")
    return out.select("session_id", "strategies", "saved_dedup", "saved_shrink", "saved_middle", "saved", reason.alias("skipped"))
