"""Keyed stateful streams, and the same folds over bounded batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def coalesced(events: DataFrame, delay_ms: int = 2000) -> DataFrame:
    """Debounce: the latest event (session_id, seq, payload) of a session once a fixed time has passed since the first that waits."""

    def step(key, pdfs, state: GroupState):
        first, seq, payload = state.get if state.exists else (None, -1, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "seq": [seq], "payload": [payload]})
            return
        for pdf in pdfs:
            last = pdf.loc[pdf["seq"].idxmax()]
            if last["seq"] > seq:
                seq, payload = int(last["seq"]), last["payload"]
        now = state.getCurrentProcessingTimeMs()
        first = first if first is not None else now
        state.update((first, seq, payload))
        state.setTimeoutDuration(max(1, first + delay_ms - now))

    kind = dict(events.dtypes)["session_id"]
    return events.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, seq long, payload string", "first long, seq long, payload string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reassembled(chunks: DataFrame) -> DataFrame:
    """Answers from their streamed pieces (response_id, seq, delta, model, finish): contents in order, the last model and finish reason."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = chunks.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("all"), last("model").alias("model"), last("finish").alias("finish"), F.count("*").alias("chunks"))
    text = F.array_join(F.transform("all", lambda x: F.coalesce(x["delta"], F.lit(""))), "")
    return out.select("response_id", text.alias("content"), "model", "finish", "chunks")


def captured(chunks: DataFrame, most: int = 512 * 1024) -> DataFrame:
    """Answers from their chunks as they came (response_id, seq, payload): (response_id, content, model, finish, usage, chunks, truncated).

    A running sum of bytes ends an answer before the first chunk that would exceed `most`. Model, finish reason and usage (JSON) are the last that were told; payloads that aren't JSON count, but say nothing.
    """
    order = Window.partitionBy("response_id").orderBy("seq")
    rows = chunks.withColumn("upto", F.sum(F.octet_length("payload")).over(order)).withColumn("over", F.max(F.when(F.col("upto") > most, 1).otherwise(0)).over(order) == 1)
    told = lambda p: F.nullif(F.get_json_object("payload", p), F.lit(""))
    text = F.coalesce(told("$.choices[0].delta.content"), F.when(F.coalesce(told("$.choices[0].delta"), F.lit("{}")) == "{}", told("$.choices[0].message.content")), F.lit(""))
    rows = rows.withColumns({"text": text, "model": told("$.model"), "finish": told("$.choices[0].finish_reason"), "usage": told("$.usage")})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & ~F.col("over"), F.col("seq")))
    out = rows.groupBy("response_id").agg(F.array_sort(F.collect_list(F.when(~F.col("over"), F.struct("seq", "text")))).alias("all"), last("model").alias("model"), last("finish").alias("finish"), last("usage").alias("usage"), F.count_if(~F.col("over")).alias("chunks"), F.max("over").alias("truncated"))
    return out.select("response_id", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("content"), "model", "finish", "usage", "chunks", "truncated")


def call_deltas(chunks: DataFrame) -> DataFrame:
    """Tool calls from their deltas (response_id, seq, index, id, name, arguments): the id and name that came first, arguments in order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = chunks.groupBy("response_id", "index").agg(first("id").alias("id"), first("name").alias("name"), F.array_sort(F.collect_list(F.struct("seq", "arguments"))).alias("all"))
    return out.select("response_id", "index", "id", "name", F.array_join(F.transform("all", lambda x: F.coalesce(x["arguments"], F.lit(""))), "").alias("arguments"))


def windowed_modes(traces: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Turns, tokens and failures of each mode per window; on a stream, with a watermark."""
    rows = traces.withWatermark("created_at", late) if traces.isStreaming else traces
    out = rows.groupBy(F.window("created_at", width), "assembly_mode").agg(F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.count_if("failed").alias("failures"))
    return out.select(F.col("window.start").alias("start"), "assembly_mode", "turns", "input_tokens", "failures")


def expired(activity: DataFrame, hours: int) -> DataFrame:
    """On a stream of (session_id, at): sessions as they end, by a gap of so many hours."""
    rows = activity.withWatermark("at", f"{hours} hours") if activity.isStreaming else activity
    return rows.groupBy("session_id", F.session_window("at", f"{hours} hours")).agg(F.count("*").alias("events")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def latest_first(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """A bounded first-in first-out trail: the newest `most` keys by first sight."""
    first = rows.groupBy(key).agg(F.min(order).alias("first_seen"))
    return first.orderBy(F.desc("first_seen"), F.desc(key)).limit(most)
