"""Roll-ups and ordered folds over traces: one row per turn of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price per million tokens.
PRICE = {"input": 0.14, "cached": 0.0028, "output": 0.28}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def session_summary(traces: DataFrame) -> DataFrame:
    """Counts, sums, times, savings ratios and the histogram of modes per session; the histogram is summed before turns are."""
    by_mode = traces.groupBy("session_id", "assembly_mode").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("input"), F.sum("savings_tokens").alias("saved"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
        F.count_if("recall_used").alias("recalls"), F.max("turn_number").alias("turn"),
    )
    rewritten = F.col("assembly_mode") != "passthrough"
    modes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("assembly_mode", "n"))), lambda m: F.concat(m["assembly_mode"], F.lit(":"), m["n"].cast("string"))), ",")
    out = by_mode.groupBy("session_id").agg(
        F.sum("n").alias("turns"), F.sum("input").alias("input_tokens"), F.sum("saved").alias("savings_tokens"), F.min("first").alias("first_at"), F.max("last").alias("last_at"),
        F.sum("recalls").alias("recalls"), F.max("turn").alias("max_turn"), modes.alias("modes"),
        F.sum(F.when(rewritten, F.col("input")).otherwise(0)).alias("ri"), F.sum(F.when(rewritten, F.col("saved")).otherwise(0)).alias("rs"),
    )
    return out.withColumns({"savings_ratio": _ratio(F.col("savings_tokens"), F.col("input_tokens")), "rewritten_ratio": _ratio(F.col("rs"), F.col("ri"))}).drop("ri", "rs")


def global_metrics(traces: DataFrame) -> DataFrame:
    """Rates, cost and latency over all turns; one row."""
    n, inputs, saved = F.count("*"), F.sum("input_tokens"), F.sum("savings_tokens")
    curated = F.col("assembly_mode") == "curator"
    return traces.agg(
        n.alias("turns"), F.count_distinct("session_id").alias("sessions"), _ratio(F.count_if("recall_used"), n).alias("recall_rate"), _ratio(F.count_if("failed"), n).alias("failure_rate"),
        _ratio(saved, inputs).alias("savings_ratio"), (inputs * PRICE["input"] / 1e6).alias("cost"), (saved * PRICE["input"] / 1e6).alias("saved_cost"),
        F.coalesce(F.avg(F.when(curated, F.col("latency_ms"))), F.lit(0.0)).alias("curator_latency"),
    )


def cache_costs(traces: DataFrame) -> DataFrame:
    """Tokens that an upstream cache had and hadn't (cache_hit_tokens, cache_miss_tokens), its hit rate, and the cost of input at both prices; without any such tokens all input is at the full price."""
    hit, miss = F.coalesce(F.sum("cache_hit_tokens"), F.lit(0)), F.coalesce(F.sum("cache_miss_tokens"), F.lit(0))
    full = F.coalesce(F.sum("input_tokens"), F.lit(0)) * PRICE["input"] / 1e6
    cost = F.when(hit + miss > 0, hit * PRICE["cached"] / 1e6 + miss * PRICE["input"] / 1e6).otherwise(full)
    return traces.agg(hit.alias("hits"), miss.alias("misses"), _ratio(hit, hit + miss).alias("hit_rate"), cost.alias("cost"), full.alias("uncached_cost"))


def briefing_freshness(traces: DataFrame) -> DataFrame:
    """The turn of each turn's latest earlier briefing, and whether that is fresh: not before the previous turn."""
    made = F.when(F.col("assembly_mode") == "briefing", F.col("turn_number"))
    before = Window.partitionBy("session_id").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = traces.withColumn("briefed", F.max(made).over(before))
    return rows.select("session_id", "turn_number", "briefed", F.coalesce(F.col("briefed") >= F.col("turn_number") - 1, F.lit(False)).alias("fresh"))


def mode_counts(traces: DataFrame, registered: list[str]) -> DataFrame:
    return traces.where(F.col("assembly_mode").isin(registered)).groupBy("assembly_mode").agg(F.count("*").alias("turns"))


def counters_and_gauges(samples: DataFrame) -> DataFrame:
    """A counter adds up its deltas, a gauge keeps its latest value (metric, at, value)."""
    return samples.groupBy("metric").agg(F.sum("value").alias("counter"), F.max_by("value", F.struct("at", "value")).alias("gauge"))


def nearest_rank(samples: DataFrame, phase: str, value: str, order: list[str], last: int = 1000, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles of the last so many samples of each phase: the element at (n - 1) p, rounded half to even. A phase's list is bounded by `last`."""
    recent = F.row_number().over(Window.partitionBy(phase).orderBy(*[F.desc(c) for c in order]))
    kept = samples.withColumn("_r", recent).where(F.col("_r") <= last)
    out = kept.groupBy(phase).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(value)).alias("_v"))
    at = lambda p: F.element_at("_v", F.bround((F.col("n") - 1) * F.lit(p)).cast("int") + 1)
    return out.select(phase, "n", *[at(p).alias(f"p{round(p * 100)}") for p in quantiles])


def newest(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def lru_sessions(traces: DataFrame, most: int = 1000) -> DataFrame:
    """Sessions by last activity, newest first, `most` of them."""
    last = traces.groupBy("session_id").agg(F.max("created_at").alias("last_active"))
    return last.orderBy(F.desc("last_active"), F.desc("session_id")).limit(most)


def latency_deltas(traces: DataFrame, width: int = 10) -> DataFrame:
    """Change against the turn before, and against the mean of the last `width` turns (null in the first)."""
    w = Window.partitionBy("session_id").orderBy("turn_number")
    mean = F.avg("latency_ms").over(w.rowsBetween(-(width - 1), 0))
    return traces.select(
        "session_id", "turn_number", "latency_ms", (F.col("latency_ms") - F.lag("latency_ms").over(w)).alias("delta"),
        F.when(F.col("turn_number") > 1, mean).alias("trailing_mean"), F.when(F.col("turn_number") > 1, F.col("latency_ms") - mean).alias("trailing_delta"),
    )


def failure_streaks(traces: DataFrame, opens: int = 3, disables: int = 10) -> DataFrame:
    """Longest run of failures and whether a circuit would have opened or been disabled."""
    w = Window.partitionBy("session_id").orderBy("turn_number")
    islands = traces.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    runs = islands.groupBy("session_id", "island").agg(F.count_if("failed").alias("run"))
    out = runs.groupBy("session_id").agg(F.max("run").alias("longest"), F.sum("run").alias("failures"))
    return out.select("session_id", "longest", "failures", (F.col("longest") >= opens).alias("opened"), (F.col("failures") >= disables).alias("disabled"))


def runs_below(traces: DataFrame, limit: float, least: int = 3) -> DataFrame:
    """Runs of at least so many turns in a row whose value lies below the limit (output collapse)."""
    w = Window.partitionBy("session_id").orderBy("turn_number")
    low = F.col("latency_ms") < limit
    islands = traces.withColumn("island", F.sum(F.when(low, 0).otherwise(1)).over(w)).where(low)
    return islands.groupBy("session_id", "island").agg(F.min("turn_number").alias("from_turn"), F.max("turn_number").alias("to_turn"), F.count("*").alias("run")).where(F.col("run") >= least).drop("island")


def folded_events(traces: DataFrame, folded: list[str]) -> DataFrame:
    """Events that are shown, each with the number of folded ones since the last shown one."""
    w = Window.partitionBy("session_id").orderBy("turn_number")
    shown = ~F.col("assembly_mode").isin(folded)
    rows = traces.withColumn("_hidden", F.sum(F.when(shown, 0).otherwise(1)).over(w)).where(shown)
    return rows.select("session_id", "turn_number", "assembly_mode", (F.col("_hidden") - F.coalesce(F.lag("_hidden").over(w), F.lit(0))).alias("folded"))


def expired_sessions(traces: DataFrame, now: Column, hours: int) -> DataFrame:
    """Sessions whose last activity lies more than so many hours back."""
    last = traces.groupBy("session_id").agg(F.max("created_at").alias("last_active"))
    return last.where(now - F.col("last_active") > F.make_dt_interval(F.lit(0), F.lit(hours)))


def running_budget(traces: DataFrame, budget: int) -> DataFrame:
    """Running input tokens and whether they exceed the budget."""
    w = Window.partitionBy("session_id").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("input_tokens").over(w)
    return traces.select("session_id", "turn_number", total.alias("running_tokens"), (total > budget).alias("exceeded"))


def recall_events(traces: DataFrame) -> DataFrame:
    return traces.where("recall_used").select("session_id", "turn_number", "created_at", "input_tokens")


def page(traces: DataFrame, session, offset: int, limit: int) -> DataFrame:
    """A page of one session's turns."""
    return traces.where(F.col("session_id") == session).orderBy("turn_number").offset(offset).limit(limit)


def rewrite_gate(traces: DataFrame, cold: int = 2, low_tokens: int = 2000, low_ratio: float = 0.1) -> DataFrame:
    """Why a turn is passed through or rewritten, first rule first."""
    ratio = _ratio(F.col("savings_tokens"), F.col("input_tokens"))
    gate = F.when(F.col("turn_number") <= cold, "cold_start").when(F.col("input_tokens") < low_tokens, "low_tokens").when(ratio < low_ratio, "low_savings").otherwise("graph")
    return traces.select("session_id", "turn_number", gate.alias("gate"))


def reconcile_turns(graph: DataFrame, traces: DataFrame) -> DataFrame:
    """A graph's turn counter (session_id, graph_turn) against its traces: class of the difference, and the turn it should have."""
    seen = traces.groupBy("session_id").agg(F.max("turn_number").alias("trace_turn"))
    both = graph.join(seen, "session_id", "full")
    g, t = F.coalesce("graph_turn", F.lit(0)), F.coalesce("trace_turn", F.lit(0))
    state = F.when((g == 0) & (t > 0), "orphan").when(t > g + 1, "mismatch").otherwise("ok")
    return both.select("session_id", g.cast("long").alias("graph_turn"), t.cast("long").alias("trace_turn"), state.alias("state"), F.greatest(g, t).cast("long").alias("turn"))


def savings(traces: DataFrame) -> DataFrame:
    """Tokens after the rewrite, what it saved, never below zero, and the share."""
    saved = F.greatest(F.lit(0).cast("long"), F.least(F.col("savings_tokens"), F.col("input_tokens")))
    return traces.select("session_id", "turn_number", (F.col("input_tokens") - saved).alias("sent_tokens"), saved.alias("saved_tokens"), _ratio(saved, F.col("input_tokens")).alias("ratio"))
