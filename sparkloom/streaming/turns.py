"""The newest turns of each session as state with a bound and an idle time, on a stream and as a fold over a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a row of the result says of a turn; times are microseconds there and in the state.
GONE = "session_id string, turn_number long, us long, why string"
#: State stores that hold lists need this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestTurns(StatefulProcessor):
    """Keeps the newest `most` turns of a session in a list, lets the oldest go when it is full, and all when nothing has come for `idle` seconds of event time."""

    def __init__(self, most: int, idle: int):
        self.most, self.idle = most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn_number long, us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [(t[1], t[0]) for t in self.turns.get()]
        for at, number in sorted((r.us, r.turn_number) for r in rows):
            if held and at - held[-1][0] > self.idle * 1_000_000:
                yield from self._gone(key, held, "idle")
                held = []
            held.append((at, number))
            if len(held) > self.most:
                yield from self._gone(key, held[:1], "full")
                held = held[1:]
        self.turns.put([(number, at) for at, number in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[-1][0] // 1000 + self.idle * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._gone(key, [(t[1], t[0]) for t in self.turns.get()], "idle")
        self.turns.clear()

    def _gone(self, key, turns, why: str) -> Iterator[Row]:
        for at, number in turns:
            yield Row(session_id=str(key[0]), turn_number=number, us=at, why=why)

    def close(self) -> None:
        pass


def gone(turns: DataFrame, most: int = 100, idle: int = 1800, late: str = "0 seconds") -> DataFrame:
    """On a stream of turns (session_id, turn_number, at): those that leave the state, as they leave it, because it is full or its session idle.

    A session's turns have to come in order of time; those that come later than `late` after the newest of all are left out. The session needs PROVIDER as its state store.
    """
    rows = turns.select("session_id", F.col("turn_number").cast("long").alias("turn_number"), "at", F.unix_micros("at").alias("us")).withWatermark("at", late)
    out = rows.groupBy("session_id").transformWithState(NewestTurns(most, idle), GONE, "append", "eventTime")
    return out.select("session_id", "turn_number", F.timestamp_micros("us").alias("at"), "why")


def fold(turns: DataFrame, most: int = 100, idle: int = 1800) -> DataFrame:
    """The same over a table: why each turn (session_id, turn_number, at) left the state; null for those that are still held when the last turn of all has come."""
    turns = turns.withColumn("at", F.col("at").cast("timestamp"))
    order = Window.partitionBy("session_id").orderBy("at", "turn_number")
    gap = F.col("at").cast("double") - F.lag("at").over(order).cast("double")
    rows = turns.withColumn("stay", F.sum(F.when(gap > idle, 1).otherwise(0)).over(order))
    stay = Window.partitionBy("session_id", "stay")
    rank = F.row_number().over(stay.orderBy(F.desc("at"), F.desc("turn_number")))
    last = F.max("stay").over(Window.partitionBy("session_id"))
    rows = rows.withColumns({"rank": rank, "last": last, "end": F.max("at").over(stay)})
    now = turns.agg(F.max("at").alias("now"))
    over = (F.col("stay") < F.col("last")) | (F.col("now").cast("double") - F.col("end").cast("double") > idle)
    why = F.when(F.col("rank") > most, "full").when(over, "idle")
    return rows.join(F.broadcast(now)).select(F.col("session_id").cast("string").alias("session_id"), F.col("turn_number").cast("long").alias("turn_number"), "at", why.alias("why"))  # one row


def held(turns: DataFrame, most: int = 100, idle: int = 1800) -> DataFrame:
    """The turns that the state holds in the end."""
    return fold(turns, most, idle).where("why is null").drop("why")
