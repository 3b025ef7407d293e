"""Domain views over the driver's tables: traces, tool activity, messages, facts, supersession edges and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn of a session (user)."""
    kind = F.col("event_type")
    mode = (
        F.when(kind == "view", "passthrough").when(kind == "click", "curator").when(kind == "purchase", "briefing").when(kind == "signup", "cold_start")
        .otherwise("agent_solo_compressed")
    )
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    saved = F.when(kind.isin("click", "purchase", "error"), F.floor(F.col("value") * 40)).otherwise(F.lit(0)).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", turn.alias("turn_number"), F.col("ts").alias("created_at"), mode.alias("assembly_mode"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), saved.alias("savings_tokens"), F.col("value").alias("latency_ms"),
        (kind == "click").alias("recall_used"), (kind == "error").alias("failed"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool activity: reads, writes, searches and commands per session."""
    mode = F.col("assembly_mode")
    tool = F.when(mode == "briefing", "write").when(mode == "curator", "grep").when(mode == "agent_solo_compressed", "bash").otherwise("read")
    return traces(spark, sf_dir).select(
        "session_id", F.col("turn_number").alias("idx"), tool.alias("tool"),
        F.concat(F.lit("src/f"), (F.col("event_id") % 17).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("body "), (F.col("event_id") % 29).cast("string")).alias("content"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal facts: one for each document, with its whole text; forty in a session, one a turn."""
    kinds = ["file_state", "error", "tool_result", "decision", "state", "goal", "observation"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("fact_id"), F.expr("doc_id div 40").alias("session_id"), (F.col("doc_id") % 40 + 1).alias("source_turn"), F.col("text").alias("content"), kind.alias("fact_type"), ((F.col("n_chars") % 101) / F.lit(100.0)).alias("confidence"), (F.col("doc_id") % 5 == 0).alias("invalidated"),
    )


def supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, new_id, old_id): a fact of the next turn supersedes an invalidated one."""
    f = facts(spark, sf_dir)
    old = f.where("invalidated").select("session_id", F.col("fact_id").alias("old_id"), (F.col("source_turn") + 1).alias("source_turn"))
    return f.join(old, ["session_id", "source_turn"]).select("session_id", F.col("fact_id").alias("new_id"), "old_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached files: one for each page, twenty in a session."""
    return table(spark, sf_dir, "pages").select(
        F.expr("page_id div 20").alias("session_id"), F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("content"), F.col("page_id").alias("last_updated_turn")
    )
