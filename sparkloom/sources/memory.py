"""Memory stores as a Python data source: a writer whose rows appear all at once or not at all, a reader that looks up by dedupe key, and what adapters do with both.

A store is a folder that driver and executors reach (any file system that Arrow opens). Tasks write parts; a manifest that the driver writes last, in one move, names those that count. Rows
have a version, and the newest of a key holds, so updates and deletions are rows as well.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..operators.lineage import cut

NAME = "sparkloom_memory"
ROW = "dedupe_key string, session_id string, fact_type string, content string, confidence double, version long, deleted boolean"
ARROW = pa.schema([("dedupe_key", pa.string()), ("session_id", pa.string()), ("fact_type", pa.string()), ("content", pa.string()), ("confidence", pa.float64()), ("version", pa.int64()), ("deleted", pa.bool_())])
#: What a promotion came to.
STORED, SKIPPED = "success", "skipped"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int
    low: str | None
    high: str | None


@dataclass
class Part(InputPartition):
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.id = path, uuid.uuid4().hex  # all of a write's parts begin with its id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(f"{root}/parts", recursive=True)
        name, rows, low, high = f"{self.id}-{uuid.uuid4().hex}.parquet", 0, None, None
        try:
            with pq.ParquetWriter(f"{root}/parts/{name}", ARROW, filesystem=store) as out:
                for batch in iterator:
                    if not batch.num_rows:
                        continue
                    out.write_batch(batch.cast(ARROW))
                    ends = pc.min_max(batch.column(0)).as_py()
                    low = min((x for x in (low, ends["min"]) if x is not None), default=None)
                    high = max((x for x in (high, ends["max"]) if x is not None), default=None)
                    rows += batch.num_rows
        except BaseException:
            self._remove([name])
            raise
        return Written(name, rows, low, high)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(f"{root}/manifests", recursive=True)
        told = [m.__dict__ for m in messages if m is not None and m.rows]
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{root}/manifests/.{name}") as out:
            out.write(json.dumps(told).encode())
        store.move(f"{root}/manifests/.{name}", f"{root}/manifests/{name}.json")
        self._remove([m.part for m in messages if m is not None and not m.rows])

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        self._remove([f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)) if f.base_name.startswith(self.id)])

    def _remove(self, parts: list[str]) -> None:
        store, root = _open(self.path)
        for part in parts:
            if store.get_file_info(f"{root}/parts/{part}").type == fs.FileType.File:
                store.delete_file(f"{root}/parts/{part}")


def _manifested(path: str) -> list[dict]:
    store, root = _open(path)
    out: list[dict] = []
    for f in store.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            with store.open_input_stream(f.path) as x:
                out += json.loads(x.read())
    return out


class Reader(DataSourceReader):
    """One task for each part; parts whose keys lie beyond those asked for are left out."""

    def __init__(self, path: str):
        self.path = path
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is not None and f.attribute == ("dedupe_key",):
                self.keys = asked if self.keys is None else self.keys & asked
            yield f  # Spark looks at the rows again

    def partitions(self) -> list[Part]:
        wanted = lambda m: self.keys is None or any(m["low"] is not None and m["low"] <= k <= m["high"] for k in self.keys)
        return [Part(m["part"]) for m in _manifested(self.path) if wanted(m)] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.name:
            store, root = _open(self.path)
            with store.open_input_file(f"{root}/parts/{partition.name}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class MemorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("memories are appended; newer versions of a key hold")
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.dataSource.register(MemorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def memories(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store, with every version."""
    register(spark)
    return spark.read.format(NAME).load(path)


def append(rows: DataFrame, path: str) -> None:
    """Append rows; a part holds neighbouring keys, so that look-ups read few of them."""
    register(rows.sparkSession)
    names = [x.split()[0] for x in ROW.split(", ")]
    rows.select(*names).repartitionByRange("dedupe_key").sortWithinPartitions("dedupe_key").write.format(NAME).mode("append").save(path)


def current(rows: DataFrame) -> DataFrame:
    """The newest version of each key, without what is deleted."""
    return rows.groupBy("dedupe_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "dedupe_key"]), F.struct("version", "deleted")).alias("v")).select("dedupe_key", "v.*").where("not deleted")


def lookup(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The memories of some keys; only parts that may hold them are read."""
    return current(memories(spark, path).where(F.col("dedupe_key").isin(keys)))


def by_source(spark: SparkSession, path: str, session: str) -> DataFrame:
    return current(memories(spark, path)).where(F.col("session_id") == session)


def promote(facts: DataFrame, path: str) -> DataFrame:
    """Store promotable facts (dedupe_key, session_id, fact_type, content, confidence) that the store doesn't hold yet, one of each key, and say what came of each key: (dedupe_key, outcome)."""
    spark = facts.sparkSession
    known = current(memories(spark, path)).select("dedupe_key")
    row = F.struct("session_id", "fact_type", "content", "confidence")
    new = facts.groupBy("dedupe_key").agg(F.min(row).alias("row")).join(known.withColumn("known", F.lit(True)), "dedupe_key", "left")
    new = cut(new)  # before the store changes
    append(_versioned(new.where("known is null").select("dedupe_key", "row.*"), False), path)
    return new.select("dedupe_key", F.when(F.col("known"), SKIPPED).otherwise(STORED).alias("outcome"))


def _versioned(rows: DataFrame, deleted: bool) -> DataFrame:
    return rows.withColumn("version", F.lit(time.time_ns())).withColumn("deleted", F.lit(deleted))


def update(changes: DataFrame, path: str) -> None:
    """Newer versions of memories (dedupe_key, session_id, fact_type, content, confidence) that the store holds; others are left out."""
    known = current(memories(changes.sparkSession, path)).select("dedupe_key")
    append(_versioned(changes.join(known, "dedupe_key", "left_semi"), False), path)


def delete(keys: DataFrame, path: str) -> None:
    """Delete the memories of keys (dedupe_key)."""
    gone = current(memories(keys.sparkSession, path)).join(keys.select("dedupe_key").distinct(), "dedupe_key", "left_semi")
    append(_versioned(gone.drop("version", "deleted"), True), path)


def vacuum(path: str) -> int:
    """Remove parts that no manifest names, as lost executors leave them; not while something writes. Returns how many."""
    store, root = _open(path)
    named = {m["part"] for m in _manifested(path)}
    lost = [f for f in store.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)) if f.base_name not in named]
    for f in lost:
        store.delete_file(f.path)
    return len(lost)
