"""Idle timeouts of tasks: an error frame that comes from a timer, without any input.

A task is open from its first frame to its terminal one. Each frame arms the task's timer anew; a timer that the watermark
passes closes the task with an error frame. What comes for a closed task is dropped, late frames as well. ``idle_frames`` is the
stream (``transformWithState`` with event-time timers; a second timer drops the mark of a closed task some time later, so state
doesn't grow with finished tasks: a TTL proper needs processing time), ``idle_frames_batch`` gives the same rows of a table.

Frames of one task in one micro-batch are taken in order of time, then of ``tie``; frames without time or task are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def message(idle_ms: int) -> str:
    return f"task idle timeout: no agent activity for {idle_ms}ms"


class IdleTimeout(StatefulProcessor):
    """State of a task: when it was last active, or that it is closed."""

    def __init__(self, idle_ms: int, forget_ms: int):
        self.idle_ms, self.forget_ms = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.closed = handle.getValueState("closed", "at long")

    def close_at(self, at: int) -> None:
        self.last.clear()
        self.closed.update((at,))
        self.handle.registerTimer(at + self.forget_ms)

    def error(self, key: tuple, last: int) -> dict:
        self.close_at(last + self.idle_ms)
        return {"task": key[0], "at": pd.Timestamp(last + self.idle_ms, unit="ms"), "kind": "error", "text": message(self.idle_ms)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.closed.exists():
            for _ in rows:
                pass
            return
        last = self.last.get()[0] if self.last.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        out = []
        ended = False
        for row in pd.concat(list(rows)).sort_values(["at", "tie"]).itertuples():
            at = int(row.at.timestamp() * 1000)
            if last is not None and at >= last + self.idle_ms:
                out.append(self.error(key, last))
                ended = True
                break
            last = at if last is None else max(at, last)
            out.append({"task": key[0], "at": row.at, "kind": "terminal" if row.terminal else "frame", "text": row.text})
            if row.terminal:
                self.close_at(at)
                ended = True
                break
        if not ended:
            self.last.update((last,))
            self.handle.registerTimer(last + self.idle_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.closed.exists():
            self.closed.clear()
        elif self.last.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.last.get()[0] + self.idle_ms:
            yield pd.DataFrame([self.error(key, self.last.get()[0])])

    def close(self) -> None:
        pass


def _frames(frames: DataFrame, key: str, at: str, tie: str, text: Column, terminal: Column) -> DataFrame:
    rows = frames.select(F.col(key).alias("task"), F.col(at).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("tie"), text.alias("text"), F.coalesce(terminal, F.lit(False)).alias("terminal"))
    return rows.where("task is not null and at is not null")


def _out(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("task", kind), T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])


def idle_frames(stream: DataFrame, key: str, at: str, tie: str, text: Column, terminal: Column, idle_ms: int, late: str = "0 seconds", forget_ms: int = 7 * 86_400_000) -> DataFrame:
    """``task, at, kind, text`` of what passes, and an error of kind ``error`` when a task was idle for ``idle_ms``.

    The session's state store must be one with timers: set ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER``.
    ``forget_ms`` is how long, in event time, a closed task is remembered; what comes later opens it again.
    """
    rows = _frames(stream, key, at, tie, text, terminal).withWatermark("at", late)
    return rows.groupBy("task").transformWithStateInPandas(IdleTimeout(idle_ms, forget_ms), _out(rows.schema["task"].dataType), "append", "eventTime")


def idle_frames_batch(frames: DataFrame, key: str, at: str, tie: str, text: Column, terminal: Column, idle_ms: int, until: Column) -> DataFrame:
    """The same of a whole table, the watermark having reached ``until``."""
    rows = _frames(frames, key, at, tie, text, terminal)
    w = Window.partitionBy("task").orderBy("at", "tie")
    ms = lambda c: F.unix_millis(c)
    over = lambda c: F.coalesce(F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    gap = ms(F.coalesce(F.lead("at").over(w), until)) - ms(F.col("at")) >= idle_ms
    seen = rows.withColumn("idle", ~F.col("terminal") & gap)
    seen = seen.withColumn("closed", over(F.col("terminal") | F.col("idle"))).where("not closed")
    own = F.struct("at", F.when(F.col("terminal"), "terminal").otherwise("frame").alias("kind"), "text")
    error = F.struct(F.timestamp_millis(ms(F.col("at")) + idle_ms).alias("at"), F.lit("error").alias("kind"), F.lit(message(idle_ms)).alias("text"))
    return seen.select("task", F.explode(F.when(F.col("idle"), F.array(own, error)).otherwise(F.array(own))).alias("f")).select("task", "f.*")
