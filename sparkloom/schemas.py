"""Schemas of the domain tables; sources read with these and never infer."""

from pyspark.sql import types as T

_tool_call = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])),
])

MESSAGE = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(_tool_call)),
    T.StructField("tool_call_id", T.StringType()),
    T.StructField("name", T.StringType()),
])

FACT = T.StructType([
    T.StructField("fact_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("fact_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source_turn", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("valid_from", T.TimestampType()),
    T.StructField("valid_until", T.TimestampType()),
])

TRACE = T.StructType([
    T.StructField("record_type", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("turn_number", T.LongType()),
    T.StructField("created_at", T.DoubleType()),
    T.StructField("assembly_mode", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("savings_tokens", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("recall_used", T.BooleanType()),
    T.StructField("_corrupt_record", T.StringType()),
])

#: Fact types by priority; fixed values.
FACT_PRIORITY = {"error": 5, "goal": 4, "state": 3, "file_state": 3, "tool_result": 2, "decision": 2, "observation": 1}
ANCHORS = ("goal", "decision")
