"""Helpers shared by the corpus operators: written tables, a filter ahead of joins, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._vectors import components

#: Rows in one Arrow batch.
BATCH = 1000
#: Bytes that a task's Parquet writer holds before it writes them.
BLOCK = 16 << 20
#: Keys for which among() makes a bitmap; it is broadcast and holds two to four bytes for each.
FILTER_KEYS = 16_000_000
#: Edges that a task of connected_components() holds at a time.
EDGES = 500_000
#: A local session's own folder, and the tables written so far.
_own: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkloom-"))
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # whole texts go to Python here: fewer of them at a time need less memory on either side
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(BATCH if int(before) <= 0 else min(int(before), BATCH)))
    try:
        df.write.option("parquet.block.size", str(BLOCK)).parquet(path)
    finally:
        spark.conf.set(batch, before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made and whose last reader is done."""
    for table in tables:
        own = {f.rsplit("/", 1)[0].split(":", 1)[-1] for f in table.inputFiles()}
        for path in [p for p in _tables if p.split(":", 1)[-1].replace("///", "/") in own or p.split(":", 1)[-1] in own]:
            _delete(table.sparkSession, path)
            _tables.remove(path)


def clean(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Delete the tables that written() made so far, but for the first `since` and those of keep; results that read them can't be used any more."""
    kept = {f.rsplit("/", 1)[0].split(":", 1)[-1].replace("///", "/") for table in keep for f in table.inputFiles()}
    for path in [p for p in _tables[since:] if p.split(":", 1)[-1].replace("///", "/") not in kept]:
        _delete(spark, path)
        _tables.remove(path)


def count() -> int:
    """How many tables there are."""
    return len(_tables)


def marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """df with a last column may_: true where the key (long) may be in the first column of keys, that is for all that are, and about one in sixteen of the others.

    A bitmap of two to four bytes for each key is broadcast, and only what it marks has to be shuffled for a join. It is made up to FILTER_KEYS keys; beyond that
    all rows are marked, and the join does the work alone.
    """
    n = keys.count()
    if n > FILTER_KEYS:
        return df.withColumn("may_", F.lit(True))
    bits = 1 << max(15, (16 * n).bit_length())
    place = lambda c: F.pmod(F.xxhash64(F.lit(77), c), F.lit(bits))
    bit = place(F.col(keys.columns[0]))
    maps = keys.select(F.shiftright(bit, 15).alias("part_"), (bit % 32768).alias("bit_")).groupBy("part_").agg(F.bitmap_construct_agg("bit_").alias("bits_"))
    there = df.withColumn("at_", place(key)).join(F.broadcast(maps), F.shiftright("at_", 15) == F.col("part_"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits_, int(at_ % 32768 div 8) + 1, 1)")), 16, 10).cast("int")
    may = F.call_function("shiftright", byte, (F.col("at_") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return there.select(*(df[c] for c in df.columns), F.coalesce(may, F.lit(False)).alias("may_"))


def among(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows that marked() marks."""
    return marked(df, key, keys).where("may_").drop("may_")


def _forest(batches):
    """Edges (u, v), u > v, that connect what the edges connect: each node with the smallest that it reaches, for EDGES edges at a time."""
    held, n = [], 0

    def out():
        u, v = np.concatenate(held, axis=1)
        ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = components(len(ids), at[: len(u)], at[len(u) :])
        some = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]])], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)]))
        n += batch.num_rows
        if n >= EDGES:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of edges (u, v) that has another neighbour; component is the smallest node reached.

    Each task first brings its own edges down to one for each node, so a hub has a row for each task at most. Then, until nothing moves: the
    smaller neighbours of a node meet and are brought down likewise, and each node moves on to its neighbour's smallest neighbour. That look-up is a
    join of two written tables, which Spark splits where many nodes hang on one.
    """
    kind = "u long, v long"
    now = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, kind), "cc")
    while True:
        star = written(now.repartition("u").mapInArrow(_forest, kind), "cc")
        up = written(star.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("to"), F.count("*").alias("n")), "cc")
        moved = F.col("to").isNotNull()
        after = written(star.join(up.select(F.col("of"), "to"), F.col("v") == F.col("of"), "left").select("u", F.coalesce("to", "v").alias("v"), moved.alias("moved")), "cc")
        more = bool(after.where("moved").head(1)) or bool(up.where("n > 1").head(1))
        drop(now, star, up)
        now = after.select("u", "v")
        if not more:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
