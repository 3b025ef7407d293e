"""Chat formatting of reply trees, in DataFrame operations only.

Messages with parents form trees. Self-joins of the parent table with itself double the length of its jumps, and carry the sum of scores along them, until no message has an
ancestor so far away; so a tree of depth d takes log2(d) joins, and each leaf then knows the score of its branch. Branches are ranked within their tree by
mean score, and only the chosen ones are enumerated, from the longest jump to the shortest, each step a join
of (leaf, message) with one table of jumps, in which each message of a path is reached once. Until then only ids and scores move. Texts are shuffled once, to their tree,
where each chosen path takes them by their places and becomes one text.

The template writes a turn as `<s>role\\ntext</s>`, turns that bear no loss as `<s>[INST] role\\ntext [/INST]</s>`. In texts and roles, a backslash is doubled and
control strings get a backslash behind their first character; reading undoes both. The loss mask is a list of places (start, length) in
the formatted text, in characters, that hold the assistant's texts.

A tree becomes one row, and all of its messages meet in the task that makes that row; nothing else is gathered. Null texts, roles and scores count as empty or 0. Messages without a parent, or
whose parent is missing, are roots; in a cycle of parents, the message with the smallest id counts as a root. Ids are unique within a tree; of rows with one id, the one with the smallest
parent has its place in the tree, and that with the smallest role and text is its message. Rows with a null id or tree are left out. In a table of conversations, turns with one number are ordered by role, then by a hash of the text; equal rows
are turns of their own. Conversations with a null id are one conversation. Very long texts make long rows. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

#: Control strings of the template; fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
#: A line end within a role; no escaped text holds this.
NEWLINE = "<\\n>"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    c = _replace(c, "\\", "\\\\")
    for x in CONTROL:
        c = _replace(c, x, x[0] + "\\" + x[1:])
    return c


def unescape(c: Column) -> Column:
    for x in CONTROL:
        c = _replace(c, x[0] + "\\" + x[1:], x)
    return _replace(c, "\\\\", "\\")


def _jumps(ids: DataFrame) -> tuple[list[DataFrame], bool]:
    """Tables (tree, node, to, sum, len), the k-th with the ancestor 2 ** k steps up, or none where the root is nearer, and the sum and number of scores before it; each holds
    only what had an ancestor in the one before. And whether some nodes never end."""
    level = _shared.written(ids.select("tree", "node", F.col("parent").alias("to"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("len")), "jump")
    jumps, n = [level], level.count()
    while jumps[-1].where("to is not null").head(1):
        if 2 ** (len(jumps) - 1) > n:
            return jumps, True
        above = _ended(jumps).union(jumps[-1].where("to is not null"))
        above = above.select(F.col("tree").alias("t"), F.col("node").alias("at"), F.col("to").alias("far"), F.col("sum").alias("more"), F.col("len").alias("rest"))
        longer = jumps[-1].where("to is not null").join(above, (F.col("tree") == F.col("t")) & (F.col("to") == F.col("at")))
        jumps.append(_shared.written(longer.select("tree", "node", F.col("far").alias("to"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("len") + F.col("rest")).alias("len")), "jump"))
    return jumps, False


def _ended(jumps: list[DataFrame]) -> DataFrame:
    """The rows that have reached their root."""
    out = jumps[0].where("to is null")
    for jump in jumps[1:]:
        out = out.union(jump.where("to is null"))
    return out


def _cut_cycles(ids: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """ids without the parent of the smallest node of each cycle."""
    inside = jumps[-1].where("to is not null").select(F.col("tree").alias("t"), F.col("to").alias("n")).distinct()
    now = ids.join(inside, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "node", F.col("parent").alias("to"), F.col("node").alias("low"))
    now = _shared.written(now, "cycle")
    for _ in jumps:
        up = now.select(F.col("tree").alias("t"), F.col("node").alias("at"), F.col("to").alias("far"), F.col("low").alias("lower"))
        now = _shared.written(now.join(up, (F.col("tree") == F.col("t")) & (F.col("to") == F.col("at"))).select("tree", "node", F.col("far").alias("to"), F.least("low", "lower").alias("low")), "cycle")
    first = now.where("low = node").select(F.col("tree").alias("t"), F.col("node").alias("n"))
    cut = ids.join(first, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")), "left")
    return cut.select("tree", "node", "place", F.when(F.col("n").isNull(), F.col("parent")).alias("parent"), "score")


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, total, up, place) for the `top` root-to-leaf paths of each tree by mean score of their messages, ties to the smaller leaf; up counts
    from the leaf (0) to the root, place is a message's rank (from 1) by id within its tree."""
    ids = messages.where("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0)).cast("double")).alias("score"))
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy("node")))
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("known"))
    ids = ids.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("known")), "left").select("tree", "node", "place", F.col("known").alias("parent"), "score")
    ids = _shared.written(ids, "ids")
    jumps, cyclic = _jumps(ids)
    if cyclic:
        ids = _shared.written(_cut_cycles(ids, jumps), "ids")
        jumps, _ = _jumps(ids)
    inner = ids.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("inner")).distinct()
    leaves = _ended(jumps).join(inner, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("inner")), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("sum") / F.col("len")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= top)
    reached = chosen.select("tree", "leaf", "rank", "total", F.lit(0).cast("long").alias("up"), F.col("leaf").alias("node"))
    for k in range(len(jumps) - 2, -1, -1):
        step = jumps[k].where("to is not null").select(F.col("tree").alias("t"), F.col("node").alias("from"), "to")
        more = reached.join(step, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("from")))
        reached = _shared.written(reached.union(more.select("tree", "leaf", "rank", "total", (F.col("up") + 2**k).alias("up"), F.col("to").alias("node"))), "paths")
    place = ids.select(F.col("tree").alias("t"), F.col("node").alias("n"), "place")
    return reached.join(place, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", "total", "up", "place")


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss) for messages (tree, node, parent, role, text, score); loss: array of (start, length)."""
    path = best_paths(messages, top).groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "place"))).alias("path"))
    said = F.struct("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = messages.where("node is not null").groupBy("tree").agg(F.array_sort(F.collect_list(said)).alias("held"))
    held = held.select(F.col("tree").alias("t"), F.expr("filter(held, (m, i) -> i = 0 or m.node <> held[i - 1].node)").alias("held"))
    role, text = (lambda m: _replace(escape(m["role"]), "\n", NEWLINE)), (lambda m: escape(m["text"]))
    bears = lambda m: m["role"] == ASSISTANT
    turns = F.transform(
        F.transform("path", lambda p: F.element_at("held", p["place"])),
        lambda m: F.struct(
            F.when(bears(m), F.concat(F.lit("<s>"), role(m), F.lit("\n"))).otherwise(F.concat(F.lit("<s>[INST] "), role(m), F.lit("\n"))).alias("head"), text(m).alias("text"),
            F.when(bears(m), F.lit("</s>")).otherwise(F.lit(" [/INST]</s>")).alias("tail"), bears(m).alias("loss"),
        ),
    )
    whole = path.join(held, F.col("tree") == F.col("t")).select("tree", "leaf", "rank", turns.alias("turns"))
    sizes = F.transform("turns", lambda t: F.char_length(t["head"]) + F.char_length(t["text"]) + F.char_length(t["tail"]))
    starts = F.expr("aggregate(sizes, cast(array(0) as array<int>), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))")
    places = F.expr("transform(turns, (t, i) -> struct(starts[i] + char_length(t.head) as start, char_length(t.text) as length, t.loss as loss))")
    whole = whole.withColumn("sizes", sizes).withColumn("starts", starts).withColumn("places", places)
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], t["tail"])), "")
    loss = F.expr("transform(filter(places, p -> p.loss), p -> struct(p.start as start, p.length as length))")
    return whole.select("tree", "leaf", "rank", formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: str = "formatted") -> Column:
    """The array of (role, text) that a formatted text holds."""
    parts = F.filter(F.split(F.col(formatted), "</s>", -1), lambda p: p != "")
    inst = lambda p: p.startswith("<s>[INST] ")
    body = F.transform(parts, lambda p: F.when(inst(p), p.substr(F.lit(11), F.char_length(p) - 18)).otherwise(p.substr(F.lit(4), F.char_length(p))))
    return F.transform(
        body,
        lambda b: F.struct(
            unescape(_replace(F.substring_index(b, "\n", 1), NEWLINE, "\n")).alias("role"),
            unescape(b.substr(F.char_length(F.substring_index(b, "\n", 1)) + 2, F.char_length(b))).alias("text"),
        ),
    )


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as messages: each turn replies to the one before it."""
    rows = conversations.select(F.struct(F.col("conv_id").cast("long").alias("id")).alias("tree"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "hash")
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation with digests of what its formatted text says when it is read back."""
    done = format_trees(conversation_trees(conversations)).withColumn("read", read_turns())
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda p: unescape(F.col("formatted").substr(p["start"] + 1, p["length"]))), "")
    return done.select(
        F.col("tree.id").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one that is made of control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), said.alias("text"))
    return digests(rows.unionByName(odd))
