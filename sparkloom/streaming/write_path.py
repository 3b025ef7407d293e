"""What a finished turn leaves behind, as a stream: facts, touched files, closed facts, edges and promotions, batch by batch.

Each micro-batch is written under its number, over whatever an earlier try of the same batch left there, and reads only what batches with smaller numbers wrote; so a batch
that is run again, after a crash or from an old checkpoint, leaves the same tables. Facts stay in the order of turns, whichever way the stream is cut into batches, if a session's
turns come in order. Tables are split by a hash of the session, and a batch reads only the parts of its own sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import extraction, facts
from ..operators.lineage import cut

#: Parts of each table.
SHARDS = 64
#: A finished turn: its tool calls, facts that a model named, and descriptions of facts that no longer hold.
TURN = (
    "session_id string, turn long, calls array<struct<call_id: string, tool: string, arguments: string, result: string>>, "
    "facts array<struct<content: string, fact_type: string, confidence: double>>, invalidated array<string>"
)
TABLES = {
    "facts": "session_id string, fact_id string, turn long, pos string, content string, content_hash string, fact_type string, confidence double, source_tool string",
    "touches": "session_id string, path string, turn long, fact_id string",
    "closed": "session_id string, fact_id string, turn long",
    "supersedes": "session_id string, new_id string, old_id string, turn long",
    "promotions": "session_id string, fact_id string, turn long, dedupe_key string, content string, fact_type string, confidence double",
}
#: Facts are alike beyond this share of common words, and a description means the fact that matches it so well at least.
ALIKE, MEANS = 0.85, 0.6


def _shard() -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(SHARDS)).cast("int")


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table as far as it is written, with batch and shard; empty before the first batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    schema = TABLES[table] + ", batch long, shard int"
    return spark.read.schema(schema).parquet(f"{path}/{table}") if there else spark.createDataFrame([], schema)


def open_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts that no later turn has closed."""
    return stored(spark, path, "facts").join(stored(spark, path, "closed").select("session_id", "fact_id"), ["session_id", "fact_id"], "left_anti")


def _write(rows: DataFrame, path: str, table: str, batch: int) -> None:
    names = [x.split()[0] for x in TABLES[table].split(", ")]
    rows.select(*names, _shard().alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/{table}/batch={batch}")


def _parsed(turns: DataFrame) -> DataFrame:
    """Facts of turns, those of tools before those of the model, with a place (pos) that orders a session's facts."""
    place = lambda group, *c: F.concat_ws("/", F.lpad(F.col("turn").cast("string"), 19, "0"), F.lit(group), *[F.lpad(F.col(x).cast("string"), 9, "0") for x in c])
    calls = turns.select("session_id", "turn", F.posexplode("calls").alias("at", "c"))
    calls = calls.select("session_id", "turn", F.col("at").alias("call_id"), "c.tool", "c.arguments", "c.result")
    tools = extraction.extracted(calls).select("session_id", "turn", place("a", "call_id", "pos").alias("pos"), "content", "fact_type", "confidence", F.col("tool").alias("source_tool"), "touched")
    said = turns.select("session_id", "turn", F.posexplode("facts").alias("at", "f")).where("trim(coalesce(f.content, '')) <> ''")
    known = F.when(F.col("f.fact_type").isin(*facts.FACT_PRIORITY), F.col("f.fact_type")).otherwise("observation")
    said = said.select("session_id", "turn", place("b", "at").alias("pos"), "f.content", known.alias("fact_type"), F.coalesce("f.confidence", F.lit(0.5)).alias("confidence"), F.lit(None).cast("string").alias("source_tool"), F.lit(None).cast("string").alias("touched"))
    out = tools.union(said)
    return out.withColumn("fact_id", F.substring(F.sha2(F.concat_ws(":", "session_id", "pos"), 256), 1, 16)).withColumn("content_hash", T.content_hash(F.col("content")))


def fresh(new: DataFrame, known: DataFrame) -> DataFrame:
    """Facts of a batch (session_id, fact_id, pos, content, content_hash) that stay: no known fact of their session, and no earlier one of the batch that stays, is equal or nearly so."""
    first = new.groupBy("session_id", "content_hash").agg(F.min_by("fact_id", "pos").alias("fact_id"))
    new = new.join(first, ["session_id", "content_hash", "fact_id"], "left_semi").join(known.select("session_id", "content_hash").distinct(), ["session_id", "content_hash"], "left_anti")
    side = lambda d: d.select("session_id", F.col("fact_id").alias("id"), "content")
    near = facts.token_pairs(side(new), side(known), ["session_id"], ALIKE, strict=True).select("session_id", F.col("a").alias("fact_id")).distinct()
    return facts.without_near_known(cut(new.join(near, ["session_id", "fact_id"], "left_anti")), known.limit(0), ALIKE)


def closings(told: DataFrame, pool: DataFrame) -> DataFrame:
    """(session_id, fact_id, turn): for each description (session_id, turn, id, content) the fact of an earlier turn that it closes: of those still open the best match.

    A description can't close what an earlier one has closed, so the turns of a session that hold descriptions are taken one after another, those of all sessions at once.
    """
    rank = F.dense_rank().over(facts.Window.partitionBy("session_id").orderBy("turn"))
    told = cut(told.withColumn("round", rank))
    closed = told.sparkSession.createDataFrame([], TABLES["closed"])
    for now in range(1, (told.agg(F.max("round")).first()[0] or 0) + 1):
        own = told.where(F.col("round") == now)
        open_ = pool.join(closed.select("session_id", "fact_id"), ["session_id", "fact_id"], "left_anti").join(own.select("session_id", F.col("turn").alias("now")).distinct(), "session_id")
        open_ = open_.where("turn < now").select("session_id", "fact_id", "content", F.lit(False).alias("invalidated"))
        hit = facts.best_match(own.select("session_id", "id", "content"), open_, MEANS).join(own.select("session_id", F.col("id").alias("description_id"), "turn"), ["session_id", "description_id"])
        closed = cut(closed.union(hit.select("session_id", "fact_id", "turn").distinct()))
    return closed


def store_batch(turns: DataFrame, path: str, batch: int) -> None:
    """Store what a batch of turns (TURN) brings under its number: parse, drop what is known, store, touch, close, promote."""
    spark = turns.sparkSession
    found = cut(_parsed(turns))
    shards = [r[0] for r in turns.select(_shard().alias("s")).distinct().collect()]  # SHARDS at most
    before = lambda table: stored(spark, path, table).where((F.col("batch") < batch) & F.col("shard").isin(shards))
    known = before("facts").join(turns.select("session_id").distinct(), "session_id", "left_semi")
    new = cut(fresh(found, known))
    _write(new, path, "facts", batch)
    _write(found.where("touched is not null").select("session_id", F.col("touched").alias("path"), "turn", "fact_id"), path, "touches", batch)
    told = turns.select("session_id", "turn", F.posexplode("invalidated").alias("at", "content")).where("trim(coalesce(content, '')) <> ''")
    told = told.withColumn("id", F.sha2(F.concat_ws(":", "session_id", "turn", "at"), 256)).drop("at")
    pool = known.join(before("closed").select("session_id", "fact_id"), ["session_id", "fact_id"], "left_anti")
    closed = closings(told, pool.select("session_id", "fact_id", "turn", "content").union(new.select("session_id", "fact_id", "turn", "content")))
    _write(closed, path, "closed", batch)
    edges = new.join(closed.withColumnRenamed("fact_id", "old_id"), ["session_id", "turn"]).select("session_id", F.col("fact_id").alias("new_id"), "old_id", "turn")  # each new fact of a turn supersedes what the turn closes
    _write(edges, path, "supersedes", batch)
    promoted = facts.promotable(new.withColumn("invalidated", F.lit(False)))
    _write(promoted.join(before("promotions").select("dedupe_key").distinct(), "dedupe_key", "left_anti"), path, "promotions", batch)


def start(spark: SparkSession, source: str, path: str, checkpoint: str, files: int = 100, store=store_batch) -> StreamingQuery:
    """Store all turns in the JSON files of a folder, so many files a batch, and go on where the checkpoint says."""
    turns = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files).json(source)
    return turns.writeStream.foreachBatch(lambda rows, batch: store(cut(rows), path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
