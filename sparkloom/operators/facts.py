"""Temporal facts: filters, duplicates, invalidation, supersession, scores and token budgets, for all sessions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ANCHORS, FACT_PRIORITY
from .lineage import cut


def active(facts: DataFrame, pool: int = 200) -> DataFrame:
    """The newest open facts of each session."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("source_turn"), F.desc("fact_id")))
    return facts.where("not invalidated").withColumn("_r", rank).where(F.col("_r") <= pool).drop("_r")


def filtered(facts: DataFrame, kinds=None, least_confidence=None, first_turn=None, last_turn=None, invalidated=False) -> DataFrame:
    """All conditions that are given, together."""
    conditions = [F.lit(True)]
    if kinds is not None:
        conditions.append(F.col("fact_type").isin(kinds))
    if least_confidence is not None:
        conditions.append(F.col("confidence") >= least_confidence)
    if first_turn is not None:
        conditions.append(F.col("source_turn") >= first_turn)
    if last_turn is not None:
        conditions.append(F.col("source_turn") <= last_turn)
    if not invalidated:
        conditions.append(~F.col("invalidated"))
    return facts.where(reduce(lambda a, b: a & b, conditions))


def counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("session_id").agg(F.count("*").alias("facts"), F.count_if(~F.col("invalidated")).alias("active"), F.count_if("invalidated").alias("closed"))


def type_distribution(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fact_type").agg(F.count("*").alias("facts"), F.avg("confidence").alias("confidence"))


def keyword_search(facts: DataFrame, keyword: str, most: int = 20) -> DataFrame:
    """Open facts that hold a keyword, whatever its case; the newest per session."""
    return active(facts.where(F.contains(F.lower("content"), F.lit(keyword.lower()))), most)


def chains(facts: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Edges with both facts' types and turns."""
    side = lambda s: facts.select("session_id", F.col("fact_id").alias(f"{s}_id"), F.col("fact_type").alias(f"{s}_type"), F.col("source_turn").alias(f"{s}_turn"))
    return supersedes.join(side("new"), ["session_id", "new_id"]).join(side("old"), ["session_id", "old_id"])


def supersession_edges(facts: DataFrame) -> DataFrame:
    """Each new fact of a turn supersedes each fact that the turn invalidated: an equi-join on session and turn (the rule itself asks for all pairs of a turn)."""
    new = facts.where("not invalidated").select("session_id", "source_turn", F.col("fact_id").alias("new_id"))
    old = facts.where("invalidated").select("session_id", "source_turn", F.col("fact_id").alias("old_id"))
    return new.join(old, ["session_id", "source_turn"]).select("session_id", "new_id", "old_id")


def exact_duplicates(facts: DataFrame) -> DataFrame:
    """The first fact of each content within a session, and how often it occurs. Contents are compared by hash of their normal form."""
    hashed = facts.select("session_id", "fact_id", T.content_hash(F.col("content")).alias("content_hash"))
    return hashed.groupBy("session_id", "content_hash").agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("copies"))


def first_unknown(new: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, content_hash, fact_id): the first new fact of each content that no known fact of the session has. Only ids and hashes are shuffled, once."""
    side = lambda d, i: d.select("session_id", T.content_hash(F.col("content")).alias("content_hash"), i.alias("fact_id"), F.lit(d is known).alias("_known"))
    both = side(new, F.col("fact_id")).union(side(known, F.lit(None)))
    by = both.groupBy("session_id", "content_hash").agg(F.min("fact_id").alias("fact_id"), F.max("_known").alias("_known"))
    return by.where(~F.col("_known") & F.col("session_id").isNotNull() & F.col("fact_id").isNotNull()).drop("_known")


def without_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """New facts whose content no known fact of the session has, the first of each."""
    return new.withColumn("content_hash", T.content_hash(F.col("content"))).join(first_unknown(new, known), ["session_id", "content_hash", "fact_id"], "left_semi")


def token_keys(c: Column) -> Column:
    """A text's tokens as sorted numbers: longer tokens first, which are rare ones as a rule, then by hash. The top byte is the length, the other 56 bits are the hash."""
    one = lambda w: F.shiftleft(F.lit(127).cast("long") - F.least(F.char_length(w), F.lit(127)), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8))
    return F.sort_array(F.transform(T.tokens(c), one))


def token_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float, strict: bool = False, when: Column | None = None, asks: Column | None = None, most: int = 512) -> DataFrame:
    """Pairs (keys, a, b, similarity) of left and right (keys, id, content) with token Jaccard at or above `least`, and for which `when` (of a and b) holds; `asks` (of a) may name the left facts that it can hold for.

    Groups of up to `most` facts on both sides together are joined by their keys alone: a pair's sizes are compared first, then its common tokens are counted within the join, so each fact's tokens
    are shuffled once and no candidate is. Larger groups go by a prefix filter, so their work doesn't grow with the square of the group.

    Prefix filter: with tokens in one order, a pair at or above `least` shares one of the first n - ceil(least * n) + 1 tokens of each side. The order is that of token_keys(), so
    short words, which very many facts hold, come last and make few candidates, and no counts have to be made. Only these prefixes are shuffled, and then the tokens of the pairs that share one.
    """
    large = left.select(*keys).union(right.select(*keys)).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys)
    large = F.broadcast(large)  # keys alone, one for more than `most` facts

    def sides(how: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
        one = lambda d: d.select(*keys, "id", "content").join(large, keys, how).select(*keys, "id", tokens.alias("t"))
        a = one(left)
        b = a if right is left else one(right)  # of one frame with itself, Spark makes and shuffles the tokens once
        return a.withColumnsRenamed({"id": "a", "t": "ta"}), b.withColumnsRenamed({"id": "b", "t": "tb"})

    # rounding must lose no pair that lies at the threshold itself; similarity decides
    fits = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-6
    when = F.lit(True) if when is None else when

    a, b = sides("left_anti", F.transform(T.tokens(F.col("content")), lambda w: F.xxhash64(w)))
    na, nb, k = F.size("ta"), F.size("tb"), F.size(F.array_intersect("ta", "tb"))
    enough = F.greatest(k, F.lit(0)) + 1e-6 >= F.greatest((na + nb) * (least / (1 + least)), F.lit(1.0))
    few = a.join(b, keys).where(when & fits(na, nb) & enough).select(*keys, "a", "b", (k.cast("double") / (na + nb - k)).alias("similarity"))

    def prefix(d: DataFrame, i: str, t: str) -> DataFrame:
        first = F.size(t) - F.ceil(F.lit(least) * F.size(t) - 1e-6).cast("int") + 1
        return d.where(F.size(t) > 0).select(*keys, i, F.size(t).alias(f"n{i}"), F.explode(F.slice(t, F.lit(1), F.least(first, F.size(t)))).alias("word"))

    a, b = sides("left_semi", token_keys(F.col("content")))
    near = prefix(a if asks is None else a.where(asks), "a", "ta").join(prefix(b, "b", "tb"), [*keys, "word"]).where(when & fits(F.col("na"), F.col("nb"))).select(*keys, "a", "b").distinct()
    many = near.join(a, [*keys, "a"]).join(b, [*keys, "b"]).select(*keys, "a", "b", T.jaccard(F.col("ta"), F.col("tb")).alias("similarity"))
    return few.union(many).where(F.col("similarity") > least if strict else F.col("similarity") >= least)


def best_match(descriptions: DataFrame, facts: DataFrame, least: float = 0.6) -> DataFrame:
    """For each description (session_id, id, content) the open fact of its session that matches best, ties to the smaller id."""
    open_ = facts.where("not invalidated").select("session_id", F.col("fact_id").alias("id"), "content")
    pairs = token_pairs(descriptions, open_, ["session_id"], least)
    rank = F.row_number().over(Window.partitionBy("session_id", "a").orderBy(F.desc("similarity"), "b"))
    return pairs.withColumn("_r", rank).where("_r = 1").select("session_id", F.col("a").alias("description_id"), F.col("b").alias("fact_id"), "similarity")


def near_duplicates(facts: DataFrame, more_than: float = 0.85) -> DataFrame:
    """Pairs of facts of a session whose token Jaccard lies above the threshold."""
    side = facts.select("session_id", F.col("fact_id").alias("id"), "content")
    return token_pairs(side, side, ["session_id"], more_than, strict=True, when=F.col("a") < F.col("b")).select("session_id", "a", "b", "similarity")


def without_near_known(new: DataFrame, known: DataFrame, more_than: float = 0.85) -> DataFrame:
    """New facts of a batch (session_id, fact_id, content, pos) that stay: within the batch the first of near-duplicates, then those with no near-duplicate among known facts.

    Whether a fact stays in the batch hangs on which earlier ones stayed. So in each round those stay of whose earlier near-duplicates none is undecided or stays, and
    those go of which one stays; there are as many rounds as the longest chain of near-duplicates is long.
    """
    null = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    a = new.select("session_id", F.struct(F.lit(False).alias("known"), "pos", "fact_id", null(known, "fact_id").alias("old_id")).alias("id"), "content")
    b = known.select("session_id", F.struct(F.lit(True).alias("known"), null(new, "pos"), null(new, "fact_id"), F.col("fact_id").alias("old_id")).alias("id"), "content")
    # both kinds of pairs from one join of one frame with itself, so no text is read or cut into tokens twice
    both = a.union(b)
    when = F.when(F.col("b.known"), ~F.col("a.known")).otherwise(F.col("a.pos") < F.col("b.pos"))
    pairs = token_pairs(both, both, ["session_id"], more_than, strict=True, when=when, asks=~F.col("a.known"))
    pairs = cut(pairs.select("session_id", F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b"), F.col("b.known").alias("known")))
    left = pairs.where("not known").select("session_id", "a", "b")
    gone = None
    while left.head(1):
        later = left.select("session_id", F.col("b").alias("a")).distinct()
        first = left.select("session_id", "a").distinct().join(later, ["session_id", "a"], "left_anti")
        out = cut(left.join(first, ["session_id", "a"], "left_semi").select("session_id", "b").distinct())
        gone = out if gone is None else cut(gone.union(out))
        over = out.select("session_id", F.col("b").alias("x"))
        left = cut(left.join(over.withColumnRenamed("x", "b"), ["session_id", "b"], "left_anti").join(over.withColumnRenamed("x", "a"), ["session_id", "a"], "left_anti"))
    if gone is None:
        gone = left.select("session_id", "b")
    out = gone.withColumnRenamed("b", "fact_id").union(pairs.where("known").select("session_id", "a")).distinct()
    return new.join(out, ["session_id", "fact_id"], "left_anti")


def invalidate(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with those named in ids (session_id, fact_id) closed, if they were open."""
    named = ids.select("session_id", "fact_id", F.lit(True).alias("_named")).distinct()
    return facts.join(named, ["session_id", "fact_id"], "left").withColumn("invalidated", F.col("invalidated") | F.coalesce("_named", F.lit(False))).drop("_named")


def context_window(selected: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the turns before, of and after selected ones that aren't selected themselves."""
    turns = selected.select("session_id", F.explode(F.array(F.col("source_turn") - 1, F.col("source_turn"), F.col("source_turn") + 1)).alias("source_turn")).distinct()
    return facts.join(turns, ["session_id", "source_turn"], "left_semi").join(selected.select("session_id", "fact_id"), ["session_id", "fact_id"], "left_anti")


def priority() -> Column:
    """Priority of a fact's type; 0 for unknown ones."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FACT_PRIORITY.items() for x in kv]), F.col("fact_type")), F.lit(0))


def recency(turn: Column) -> Column:
    """Decays with the logarithm of age, which is never below 0; 0.5 where a turn is unknown."""
    age = F.greatest(turn - F.col("source_turn"), F.lit(0))
    return F.when((turn > 0) & (F.col("source_turn") > 0), 1.0 / (1.0 + F.log1p(age.cast("double")))).otherwise(0.5)


def score(turn: Column) -> Column:
    """Without query or intent: 0.4 type + 0.3 confidence + 0.3 recency."""
    return priority() / F.lit(5.0) * 0.4 + F.col("confidence") * 0.3 + recency(turn) * 0.3


def scored(facts: DataFrame) -> DataFrame:
    """Facts with the score that they have at their session's last turn."""
    last = F.max("source_turn").over(Window.partitionBy("session_id"))
    return facts.withColumn("score", score(last))


def line_tokens() -> Column:
    """Token estimate of a fact as a line of context."""
    return T.tokens_by_length(F.concat(F.lit("- ["), F.col("fact_type"), F.lit("|t"), F.col("source_turn").cast("string"), F.lit("] "), F.col("content"), F.lit("\n")))


def budget_fill(facts: DataFrame, budget: int, pool: int = 200) -> DataFrame:
    """Facts that fit a session's token budget: anchors in order, skipping what doesn't fit, then the others by score up to the first that doesn't.

    The fold runs over one array for each session, which the pool bounds.
    """
    f = scored(active(facts, pool)).withColumn("tokens", line_tokens())
    anchor = F.col("fact_type").isin(*ANCHORS)
    key = F.struct(F.when(anchor, 0).otherwise(1).alias("g"), F.when(anchor, 0.0).otherwise(-F.col("score")).alias("s"), F.col("fact_id").alias("i"))
    row = F.struct(key.alias("key"), F.col("fact_id").alias("fact_id"), F.col("tokens").alias("tokens"))
    by = f.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    fold = F.expr(
        f"aggregate(all, struct(0L as used, false as stop, cast(array() as array<bigint>) as ids), (a, x) -> case"
        f" when not a.stop and a.used + x.tokens <= {int(budget)} then struct(a.used + x.tokens as used, a.stop as stop, concat(a.ids, array(x.fact_id)) as ids)"
        f" when x.key.g = 1 then struct(a.used as used, true as stop, a.ids as ids) else a end)"
    )
    return by.select("session_id", fold.alias("r")).select("session_id", F.posexplode("r.ids").alias("pos", "fact_id")).withColumn("pos", F.col("pos").cast("long"))


def budget_prefix(facts: DataFrame, budget: int) -> DataFrame:
    """The stop rule alone, as a running sum: facts by score while the sum of their tokens stays within the budget."""
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "fact_id").rowsBetween(Window.unboundedPreceding, 0)
    f = scored(facts.where("not invalidated")).withColumn("tokens", line_tokens())
    return f.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget).select("session_id", "fact_id", "score", "used")


def promotable(facts: DataFrame, kinds=("decision", "goal", "error"), floor: float = 0.9) -> DataFrame:
    """Facts to be promoted to lasting memory, with their dedupe key: open ones of these kinds that are sure enough, and those with a column `explicit` that says so."""
    key = F.substring(F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), "fact_type", "content"), 256), 1, 32)
    asked = F.coalesce(F.col("explicit"), F.lit(False)) if "explicit" in facts.columns else F.lit(False)
    return facts.where((asked | F.col("fact_type").isin(*kinds) & (F.col("confidence") >= floor)) & ~F.col("invalidated")).withColumn("dedupe_key", key)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key: an upsert's outcome."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("_v")).select(*key, "_v.*")
