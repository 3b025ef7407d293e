"""Sessions and their settings: lists, retention, configuration, budgets, caches, plug-in metrics, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import facts as facts_
from .lineage import cut


def recent(sessions: DataFrame, messages: DataFrame, most: int) -> DataFrame:
    """Sessions (session_id, updated) with their number of messages, the latest first."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    return sessions.join(n, "session_id", "left").select("session_id", "updated", F.coalesce("messages", F.lit(0)).alias("messages")).orderBy(F.desc("updated"), "session_id").limit(most)


def storage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each session in each store."""
    out = None
    for name, table in tables.items():
        one = table.groupBy("session_id").agg(F.count("*").alias("rows")).select("session_id", F.lit(name).alias("store"), "rows")
        out = one if out is None else out.union(one)
    return out


def pruned(state: DataFrame, active: DataFrame) -> DataFrame:
    """State of sessions that are still active."""
    return state.join(active.select("session_id").distinct(), "session_id", "left_semi")


def expired_rows(tables: dict[str, DataFrame], expired: DataFrame) -> DataFrame:
    """What cleaning up expired sessions deletes: their rows in each store."""
    gone = expired.select("session_id").distinct()
    return storage({name: table.join(gone, "session_id", "left_semi") for name, table in tables.items()})


def find_or_create(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sessions by fingerprint: known ones (fingerprint, session_id) and one new one for each fingerprint that is wanted and not known."""
    new = wanted.select("fingerprint").distinct().join(known, "fingerprint", "left_anti")
    return known.select("fingerprint", "session_id", F.lit(False).alias("created")).union(new.select("fingerprint", F.substring(F.sha2("fingerprint", 256), 1, 16), F.lit(True)))


def changed_keys(configs: DataFrame) -> DataFrame:
    """Keys of configurations (experiment, config) that take more than one value, or are missing somewhere."""
    n = configs.select("experiment").distinct()
    rows = configs.select("experiment", F.explode("config").alias("key", "value"))
    return rows.groupBy("key").agg(F.count_distinct("value").alias("values"), F.count_distinct("experiment").alias("experiments")).join(F.broadcast(n.agg(F.count("*").alias("all")))).where("values > 1 or experiments < all").select("key", "values", "experiments")


def dotted_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics with keys `plugin.<id>.<name>` summed by id and name."""
    parts = F.split("key", "\\.", 3)
    return metrics.where(F.col("key").startswith("plugin.") & (F.size(parts) == 3)).groupBy(parts[1].alias("plugin"), parts[2].alias("name")).agg(F.sum("value").alias("value"))


def reserved_calls(calls: DataFrame, most: int = 4, budget: int = 5000) -> DataFrame:
    """Model calls (session_id, turn, pos, tokens) that a turn's budget admits, in order: what doesn't fit is skipped, later smaller ones may still fit."""
    by = calls.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("all"))
    fold = F.expr(
        f"aggregate(all, struct(0L as n, 0L as used, cast(array() as array<bigint>) as kept), (a, x) -> if(a.n < {int(most)} and a.used + x.tokens <= {int(budget)},"
        " struct(a.n + 1 as n, a.used + x.tokens as used, concat(a.kept, array(bigint(x.pos))) as kept), a))"
    )
    return by.select("session_id", "turn", fold.alias("r")).select("session_id", "turn", F.col("r.n").alias("calls"), F.col("r.used").alias("tokens"), F.array_join("r.kept", ",").alias("kept"))


def cached(entries: DataFrame, now: float, ttl: float = 3600.0, most: int = 128) -> DataFrame:
    """Cache entries (key, at) not older than ttl seconds, the newest `most`."""
    return entries.where(F.lit(now) - F.col("at") <= ttl).orderBy(F.desc("at"), "key").limit(most)


def compression_ratio(rows: DataFrame) -> DataFrame:
    """How much shorter previews are than their texts, over all rows of a session."""
    long, short = F.sum(F.char_length(F.coalesce("content", F.lit("")))), F.sum(F.char_length(T.preview(F.coalesce("content", F.lit("")), 200)))
    return rows.groupBy("session_id").agg(long.alias("chars"), short.alias("kept_chars"), (long / F.greatest(short, F.lit(1))).alias("ratio"))


def compressed_to(messages: DataFrame, ceiling: int, keep: int = 40) -> DataFrame:
    """Messages whose texts are cut to `keep` characters until the session's tokens lie under a ceiling: longest saving last is not sought, the oldest go first.

    Each step saves a fixed amount, so the steps needed are those before the running saving reaches what is too much.
    """
    w = Window.partitionBy("session_id")
    full, cut = T.tokens_by_length(F.col("content")), T.tokens_by_length(F.substring("content", 1, keep))
    rows = messages.withColumn("full", full).withColumn("saved", F.when(F.col("role") == "system", F.lit(0).cast("long")).otherwise(full - cut))
    before = F.coalesce(F.sum("saved").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("over", F.sum("full").over(w) - ceiling).withColumn("cut", (before < F.col("over")) & (F.col("saved") > 0))
    return rows.select("session_id", "idx", "cut", F.when(F.col("cut"), F.substring("content", 1, keep)).otherwise(F.col("content")).alias("content"))


def promotion_stats(facts: DataFrame) -> DataFrame:
    """Outcomes of promoting facts: promoted once for each key, repeated, or refused by the policy."""
    able = facts_.promotable(facts.drop("dedupe_key")).select("fact_id", "dedupe_key")
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("fact_id")) == 1
    rows = facts.select("fact_id").join(able.withColumn("first", first), "fact_id", "left")
    outcome = F.when(F.col("dedupe_key").isNull(), "refused").when(F.col("first"), "promoted").otherwise("duplicate")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("facts"))


def dry_run(new: DataFrame, known: DataFrame) -> DataFrame:
    """What storing a batch would do, by session; nothing is stored."""
    kept = facts_.first_unknown(new, known)
    a = new.groupBy("session_id").agg(F.count("*").alias("offered"))
    b = kept.groupBy("session_id").agg(F.count("*").alias("stored"))
    return a.join(b, "session_id", "left").select("session_id", "offered", F.coalesce("stored", F.lit(0)).alias("stored"))


def dry_run_stages(new: DataFrame, known: DataFrame, descriptions: DataFrame) -> DataFrame:
    """What storing a batch would do, stage by stage: (session_id, offered, distinct, stored, invalidated, writes); nothing is stored.

    new and known: facts (session_id, fact_id, content, pos, invalidated); descriptions (session_id, id, content) of facts that no longer hold. distinct: without exact copies of each other or of known facts; stored: without near ones
    too; invalidated: known open facts that descriptions mean; writes: what is stored, and an edge from each to each that is invalidated.
    """
    exact = cut(facts_.first_unknown(new, known).select("session_id", "fact_id"))
    kept = facts_.without_near_known(new.join(exact.hint("shuffle_hash"), ["session_id", "fact_id"], "left_semi"), known)
    closed = facts_.best_match(descriptions, known).select("session_id", "fact_id").distinct()
    count = lambda d, n: d.groupBy("session_id").agg(F.count("*").alias(n))
    out = count(new, "offered")
    for part in (count(exact, "distinct"), count(kept, "stored"), count(closed, "invalidated")):
        out = out.join(part, "session_id", "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("distinct", "stored", "invalidated")}
    return out.withColumns(zero).withColumn("writes", F.col("stored") + F.col("invalidated") + F.col("stored") * F.col("invalidated"))


def usage(calls: DataFrame) -> DataFrame:
    """Model usage of each turn (session_id, turn, step, prompt_tokens, completion_tokens, cached_tokens, llm_calls), summed over its steps; missing numbers are 0, steps that made calls are named."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    named = F.array_join(F.array_sort(F.collect_set(F.when(F.coalesce("llm_calls", F.lit(0)) > 0, F.col("step")))), ",").alias("steps")
    return calls.groupBy("session_id", "turn").agg(n("prompt_tokens"), n("completion_tokens"), n("cached_tokens"), n("llm_calls"), named)


def recall_answer(facts: DataFrame, budget: int = 2000) -> DataFrame:
    """One text per session: its open facts within a token budget, most important first."""
    kept = facts_.budget_fill(facts, budget).join(facts, ["session_id", "fact_id"])
    line = F.concat(F.lit("- ["), F.col("fact_type"), F.lit("|t"), F.col("source_turn").cast("string"), F.lit("] "), F.regexp_replace("content", r"\s+", " "))
    out = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return out.select("session_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"), F.size("lines").cast("long").alias("facts"))


def file_checks(files: DataFrame, contains: str, least_lines: int) -> DataFrame:
    """Checks of files, and which failed."""
    lines = F.size(F.split(F.coalesce("content", F.lit("")), "\n"))
    failed = F.array_compact(F.array(
        F.when(F.coalesce("content", F.lit("")) == "", "not_empty"), F.when(~F.contains(F.coalesce("content", F.lit("")), F.lit(contains)), "contains"), F.when(lines < least_lines, "min_lines")
    ))
    return files.select("session_id", "path", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passes"))


def work_summary(facts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The newest open facts of each type, up to the type's cap."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("fact_type"))
    rank = F.row_number().over(Window.partitionBy("session_id", "fact_type").orderBy(F.desc("source_turn"), F.desc("fact_id")))
    return facts.where("not invalidated").withColumn("rank", rank.cast("long")).where(F.col("rank") <= cap).select("session_id", "fact_type", "fact_id", "rank")


def consent(headers: DataFrame) -> DataFrame:
    """Consent from a header (id, header): granted, denied or unset, whatever its case and outer blanks."""
    h = F.lower(F.trim(F.coalesce("header", F.lit(""))))
    state = F.when(h.isin("1", "true", "yes", "granted"), "granted").when(h.isin("0", "false", "no", "denied"), "denied").otherwise("unset")
    return headers.select("id", state.alias("consent"), (state == "granted").alias("allowed"))


def token_hints(requests: DataFrame) -> DataFrame:
    """A client's token count: the first valid of header, meta and body (strings), within [100, 5 000 000]."""
    def valid(c):
        n = F.col(c).try_cast("long")
        return F.when(n.between(100, 5_000_000), n)

    return requests.select("id", F.coalesce(valid("header"), valid("meta"), valid("body")).alias("tokens"))
