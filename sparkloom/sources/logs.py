"""Readers and sinks for trace logs, chat exports, event streams and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import content as C


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines of a folder of JSONL files: broken and blank lines, background passes and rows without a time are left out."""
    raw = spark.read.schema(schemas.TRACE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    file = F.col("_metadata.file_name")
    kept = raw.where(~file.contains("curator_failures")).where(F.col("_corrupt_record").isNull() & F.col("created_at").isNotNull())
    return kept.where(F.coalesce("record_type", F.lit("turn")) != "bg_pass").drop("_corrupt_record").withColumn("created_at", F.timestamp_seconds("created_at"))


def read_background(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """Background passes, the newest of each session."""
    raw = spark.read.schema(schemas.TRACE).json(path).where("record_type = 'bg_pass' and _corrupt_record is null")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at")))
    return raw.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r", "_corrupt_record")


def write_traces(traces: DataFrame, path: str) -> None:
    """Append traces as JSONL, a folder for each session; slashes in names are replaced."""
    name = F.regexp_replace(F.col("session_id").cast("string"), r"[/\\]", "_")
    traces.withColumn("session", name).write.mode("append").partitionBy("session").json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MESSAGE).json(path)


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of SSE lines, one row for each."""
    return spark.read.text(path).select(C.sse_payload(F.col("value")).alias("payload")).where("payload is not null")


def write_sse(answers: DataFrame, path: str) -> None:
    """Answers (text) as SSE lines."""
    answers.select(F.explode(C.sse_lines(F.col("text"))).alias("value")).write.mode("overwrite").text(path)


def read_files(spark: SparkSession, root: str, most_bytes: int = 1 << 20, pattern: str = "*") -> DataFrame:
    """Files under a root up to a size, as text with lines counted; nothing outside the root is listed."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    text = F.col("content").cast("string")
    return raw.select("path", text.alias("content"), F.size(F.split(text, "\n")).cast("long").alias("line_count"))


def retained(spark: SparkSession, path: str, days: int) -> DataFrame:
    """Trace lines of files that were changed within so many days."""
    return spark.read.schema(schemas.TRACE).json(path).where(F.col("_metadata.file_modification_time") >= F.current_timestamp() - F.make_dt_interval(F.lit(days)))


def chat_export(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """A relational chat store (messages: id, session_id, role, time; parts: message_id, pos, type, text) as ordered rows; parts of other types are skipped."""
    text = parts.where(F.col("type").isin("text", "tool", "tool-result")).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    rows = messages.join(text, messages["id"] == text["message_id"], "left")
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    idx = F.row_number().over(Window.partitionBy("session_id").orderBy("time", "id")) - 1
    return rows.select("session_id", idx.cast("long").alias("idx"), "role", F.coalesce(body, F.lit("")).alias("content"))


def recent_sessions(sessions: DataFrame, messages: DataFrame, most: int) -> DataFrame:
    """Sessions (id, updated) with their number of messages, the latest first."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    return sessions.join(n, sessions["id"] == n["session_id"], "left").select("id", "updated", F.coalesce("messages", F.lit(0)).alias("messages")).orderBy(F.desc("updated"), "id").limit(most)


def merge_latest(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """A batch laid over a table: the latest row of each key."""
    rest = [c for c in old.columns if c not in key]
    return old.unionByName(new).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*key, "_v.*")


def without_session(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """A table without all rows of some sessions (session_id)."""
    return table.join(sessions.select("session_id").distinct(), "session_id", "left_anti")
