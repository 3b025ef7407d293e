"""Where knowledge comes from: arguments of reads, facts about files touched, contents that were written, sessions of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import path_argument

#: Argument names by priority, and tools that write a whole file; fixed values.
ARGUMENT_KEYS = {"path": ("file_path", "path", "filePath", "filename", "target_file"), "offset": ("offset", "start_line", "start"), "limit": ("limit", "end_line", "end", "line_count")}
FULL_WRITES = ("Write", "write", "write_file", "create_file", "create")
READS = ("Read", "read_file")


def read_arguments(arguments: Column) -> Column:
    """Path, offset and limit of a read's JSON arguments; null where absent, or no number."""
    number = lambda keys: F.coalesce(*[F.get_json_object(arguments, f"$.{k}") for k in keys]).try_cast("long")
    return F.struct(path_argument(arguments, ARGUMENT_KEYS["path"]).alias("path"), number(ARGUMENT_KEYS["offset"]).alias("offset"), number(ARGUMENT_KEYS["limit"]).alias("limit"))


def file_fact(tool: Column, path: Column, result: Column, turn: Column) -> Column:
    """Struct (content, fact_type, confidence, touched) of a file call: what was read, with its lines, written or edited, and when.

    A read without a path takes the first line of its result, other calls `unknown`; only known paths count as touched.
    """
    result = F.coalesce(result, F.lit(""))
    is_read = tool.isin(*READS)
    path = F.coalesce(F.nullif(path, F.lit("")), F.when(is_read, F.nullif(F.trim(F.substring_index(result, "\n", 1)), F.lit(""))), F.lit("unknown"))
    lines = F.when(F.trim(result) != "", F.concat(F.lit(" ("), (F.char_length(result) - F.char_length(F.replace(result, F.lit("\n"), F.lit(""))) + 1).cast("string"), F.lit(" lines)"))).otherwise("")
    verb = F.when(tool == "Write", "written").otherwise("edited")
    at = F.concat(F.lit(" at turn "), turn.cast("string"))
    said = F.when(is_read, F.concat(F.lit("[Read] "), path, F.lit(" read"), at, lines)).otherwise(F.concat(F.lit("["), tool, F.lit("] "), path, F.lit(" "), verb, at))
    return F.struct(said.alias("content"), F.lit("file_state").alias("fact_type"), F.lit(1.0).alias("confidence"), F.nullif(path, F.lit("unknown")).alias("touched"))


def provenance(calls: DataFrame) -> DataFrame:
    """A fact for each file call (session_id, turn, tool, path, result); see file_fact."""
    return calls.select("session_id", "turn", file_fact(F.col("tool"), F.col("path"), F.col("result"), F.col("turn")).alias("f")).select("session_id", "turn", "f.*")


def full_writes(messages: DataFrame) -> DataFrame:
    """Contents that the last assistant message of each session writes as whole files; calls without path or content, or with broken arguments, are left out."""
    last = messages.where("role = 'assistant'").groupBy("session_id").agg(F.max_by(F.struct("idx", "tool_calls"), "idx").alias("m"))
    call = last.select("session_id", "m.idx", F.explode("m.tool_calls").alias("c")).where(F.col("c.function.name").isin(*FULL_WRITES))
    args = F.col("c.function.arguments")
    content = F.coalesce(F.nullif(F.get_json_object(args, "$.content"), F.lit("")), F.nullif(F.get_json_object(args, "$.file_content"), F.lit("")))
    rows = call.select("session_id", "idx", F.coalesce("c.id", F.lit("")).alias("tool_call_id"), path_argument(args, ARGUMENT_KEYS["path"]).alias("path"), content.alias("content"))
    return rows.where("path is not null and content is not null")


def invalidated_paths(cached: DataFrame, written: DataFrame) -> DataFrame:
    """Cached files (session_id, path) that a call has written since."""
    return cached.join(written.select("session_id", "path").distinct(), ["session_id", "path"], "left_semi")


def resolved_sessions(requests: DataFrame) -> DataFrame:
    """Session and turn of each request (request_id, session_header, affinity_header, fingerprint, last_role), in order of request_id.

    The first header with a value names the session, else the fingerprint does; a request without any is a session of its own.
    Only a request that ends with a user's message starts a turn, a session's first request counts as one.
    """
    named = F.coalesce(F.nullif("session_header", F.lit("")), F.nullif("affinity_header", F.lit("")), F.nullif("fingerprint", F.lit("")), F.concat(F.lit("request-"), F.col("request_id").cast("string")))
    order = Window.partitionBy("session").orderBy("request_id")
    rows = requests.withColumn("session", named).withColumn("created", F.row_number().over(order) == 1)
    starts = F.when(F.col("created") | (F.col("last_role") == "user"), F.lit(1).cast("long")).otherwise(0)
    return rows.withColumn("turn", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("request_id", "session", "created", "turn")
