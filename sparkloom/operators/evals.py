"""Evaluation: keyword probes, edit fidelity, comparison of runs, audits, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import rewriting


def keyword_recall(answers: DataFrame, keywords: list[str]) -> DataFrame:
    """Share of keywords that each answer (id, text) holds, whatever their case."""
    hits = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(F.coalesce("text", F.lit(""))), k))
    return answers.select("id", F.size(hits).cast("long").alias("found"), (F.size(hits) / F.lit(float(len(keywords)))).alias("recall"))


def edit_fidelity(answers: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """Share of required fragments; 0 with any forbidden one, 1 if none is required."""
    has = lambda k: F.contains(F.coalesce("text", F.lit("")), k)
    share = F.size(F.filter(F.array(*map(F.lit, required)), has)) / F.lit(float(len(required))) if required else F.lit(1.0)
    bad = F.exists(F.array(*map(F.lit, forbidden)), has) if forbidden else F.lit(False)
    return answers.select("id", F.when(bad, 0.0).otherwise(share).alias("fidelity"))


def totals(runs: DataFrame, floor: int) -> DataFrame:
    """Per arm: token sums, savings and the share of outputs below the floor (runs: arm, input, saved, output)."""
    ratio = F.coalesce(F.try_divide(F.sum("saved").cast("double"), F.sum("input").cast("double")), F.lit(0.0))
    return runs.groupBy("arm").agg(F.count("*").alias("turns"), F.sum("input").alias("input"), F.sum("saved").alias("saved"), ratio.alias("savings_ratio"), (F.count_if(F.col("output") < floor) / F.count("*")).alias("collapse_rate"))


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two runs side by side, with what only one of them has."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key, "full").select(key, "a", "b", (F.col("b") - F.col("a")).alias("change"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str, error: str = "error") -> DataFrame:
    """Two runs by instance, those left out that failed, or are missing, in one of them."""
    fine = lambda d, n: d.where(F.col(error).isNull()).select(key, F.col(value).alias(n))
    return fine(a, "a").join(fine(b, "b"), key).select(key, "a", "b", (F.col("b") - F.col("a")).alias("change"))


def arms(traces: DataFrame, arm: str, base: str) -> DataFrame:
    """Turns, tokens, savings and modes of each arm (traces: arm, assembly_mode, input_tokens, output_tokens, savings_tokens), and its input beside that of the base arm."""
    modes = traces.groupBy(arm, F.coalesce("assembly_mode", F.lit("unknown")).alias("mode")).agg(F.count("*").alias("n"))
    modes = modes.groupBy(arm).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mode", "n"))), lambda m: F.concat(m["mode"], F.lit("="), m["n"].cast("string"))), ",").alias("modes"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    sums = traces.groupBy(arm).agg(F.count("*").alias("turns"), n("input_tokens"), n("output_tokens"), n("savings_tokens"))
    other = sums.where(F.col(arm) == base).select(F.col("input_tokens").alias("base_tokens"))
    ratio = F.round(F.col("savings_tokens") / F.greatest("input_tokens", F.lit(1)), 4)
    out = sums.join(modes, arm).join(F.broadcast(other), how="left")  # one row
    return out.select(arm, "turns", "input_tokens", "output_tokens", "savings_tokens", ratio.alias("savings_ratio"), "modes", F.round(F.col("input_tokens") / F.greatest("base_tokens", F.lit(1)), 4).alias("to_base"))


def survivors(files: DataFrame, orders: dict[str, DataFrame], budgets: list[int]) -> DataFrame:
    """(strategy, budget, session_id, files, paths): which files (session_id, path, content) are left when a context is filled in each strategy's order (session_id, path, rank) under each budget of characters."""
    out = None
    for strategy, order in orders.items():
        ranked = files.select("session_id", "path", "content").join(order.select("session_id", "path", "rank"), ["session_id", "path"])
        for budget in budgets:
            kept = rewriting.code_fill(ranked, budget).groupBy("session_id").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
            part = kept.select(F.lit(strategy).alias("strategy"), F.lit(budget).alias("budget"), "session_id", "files", "paths")
            out = part if out is None else out.union(part)
    return out


def micro_average(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Coverage and precision per granularity from columns <level>_hit, <level>_gold, <level>_pred."""
    stack = ", ".join(f"'{x}', {x}_hit, {x}_gold, {x}_pred" for x in levels)
    long = rows.selectExpr(f"stack({len(levels)}, {stack}) as (level, hit, gold, pred)")
    div = lambda x, y: F.coalesce(F.try_divide(F.sum(x).cast("double"), F.sum(y).cast("double")), F.lit(0.0))
    return long.groupBy("level").agg(div("hit", "gold").alias("coverage"), div("hit", "pred").alias("precision"))


def sweep(runs: DataFrame) -> DataFrame:
    """Per arm: complete and failed runs, median, largest and mean time of complete ones (arm, complete, seconds)."""
    own = F.when(F.col("complete"), F.col("seconds"))
    return runs.groupBy("arm").agg(F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("failed"), F.percentile(own, F.lit(0.5)).alias("median"), F.max(own).alias("largest"), F.avg(own).alias("mean"))


def _common_words(facts: DataFrame, truth: DataFrame, most: int = 256) -> DataFrame:
    """(turn, id, truth_id, n, k): each truth's number n of words, and how many of them, at least one, a fact of its turn has.

    Facts and truths meet on their turn, and words are counted within the join: rows for single words would be many times as many as pairs. The truths of a turn with more
    than `most` are dealt out in parts, each beside all facts of the turn.
    """
    words = F.transform(F.filter(T.tokens(F.col("content")), lambda w: F.char_length(w) > 2), lambda w: F.xxhash64(w))
    parts = truth.groupBy("turn").agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1")
    dealt = lambda d: d.join(F.broadcast(parts), "turn", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    t = dealt(truth.select("turn", "truth_id", words.alias("tw"))).select("turn", F.pmod(F.xxhash64("truth_id"), "parts").alias("part"), "truth_id", "tw")
    f = dealt(facts.select("turn", "id", words.alias("fw"))).select("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "fw")
    k = F.size(F.array_intersect("tw", "fw"))
    return t.join(f, ["turn", "part"]).select("turn", "id", "truth_id", F.size("tw").alias("n"), k.alias("k")).where("k > 0")


def truth_overlap(facts: DataFrame, truth: DataFrame) -> DataFrame:
    """For each ground truth (turn, truth_id, content) the largest share of its words in one fact (turn, id, content) of its turn, and whether that covers it."""
    best = _common_words(facts, truth).groupBy("turn", "truth_id").agg(F.max(F.col("k").cast("double") / F.col("n").cast("double")).alias("best"))
    out = truth.select("turn", "truth_id").join(best, ["turn", "truth_id"], "left").select("turn", "truth_id", F.coalesce("best", F.lit(0.0)).alias("overlap"))
    return out.withColumn("matched", F.col("overlap") >= 0.5)


def audit(overlaps: DataFrame) -> DataFrame:
    """Accuracy over all ground truths, and the gate."""
    rate = F.coalesce(F.try_divide(F.count_if("matched").cast("double"), F.count("*").cast("double")), F.lit(0.0))
    return overlaps.agg(F.count("*").alias("truths"), F.count_if("matched").alias("matched"), rate.alias("accuracy")).withColumn("passes", F.col("accuracy") >= 0.8)


def noise(facts: DataFrame, truth: DataFrame, least: float = 0.4) -> DataFrame:
    """Whether a fact (turn, id, content) is noise: no truth (turn, truth_id, content) of its turn has so large a share of its words in it."""
    signal = _common_words(facts, truth).where(F.col("k") >= F.col("n") * least).select("turn", "id", F.lit(False).alias("noise")).distinct()
    return facts.select("turn", "id").join(signal, ["turn", "id"], "left").select("turn", "id", F.coalesce("noise", F.lit(True)).alias("noise"))


def audit_gates(answers: DataFrame, overlaps: DataFrame, noise: DataFrame) -> DataFrame:
    """Shares of answers (parsed) that could be parsed, truths (matched) that were found and facts (noise) that match no truth, and the gate over all three; one row."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    one = answers.agg(share("parsed").alias("parse_rate")).join(F.broadcast(overlaps.agg(share("matched").alias("accuracy")))).join(F.broadcast(noise.agg(share("noise").alias("noise_rate"))))
    return one.withColumn("passes", (F.col("parse_rate") >= 0.95) & (F.col("accuracy") >= 0.8) & (F.col("noise_rate") <= 0.1))


def calibration(cases: DataFrame) -> DataFrame:
    """Gap of each estimate (category, estimate, actual) in percent, its mean over cases with a gap, and the advice it gives."""
    gap = F.coalesce(F.try_divide((F.col("actual") - F.col("estimate")).cast("double") * 100, F.col("actual").cast("double")), F.lit(0.0))
    out = cases.withColumn("gap", gap).groupBy("category").agg(F.count("*").alias("cases"), F.avg(F.when(F.col("gap") != 0, F.col("gap"))).alias("mean_gap"))
    size = F.abs(F.coalesce("mean_gap", F.lit(0.0)))
    return out.withColumn("advice", F.when(size <= 10, "keep").when(size <= 30, "adjust").otherwise("recalibrate"))
