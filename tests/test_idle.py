"""Idle timeouts: the error comes from the timer, over several micro-batches and a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftmill.streaming import idle as I


@pytest.fixture
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, I.PROVIDER)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def t(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


SCHEMA = "task string, ts timestamp, n long, text string, done boolean"


def test_error_without_input_late_rows_and_restart(timers, tmp_path):
    spark = timers
    parts = [
        [("a", t(0), 1, "a0", False), ("b", t(1), 2, "b1", False), ("c", t(2), 3, "c2", True), ("d", t(0), 4, "d0", False), (None, t(1), 5, "x", False), ("e", None, 6, "x", False)],
        [("b", t(8), 7, "b8", False), ("z", t(30), 8, "z", False)],  # the watermark passes a, b and d: no frame of theirs is needed
        [("a", t(31), 9, "after", False), ("c", t(31), 10, "after", False), ("z", t(33), 11, "z33", False)],  # closed tasks
        [("y", t(90), 12, "y", False)],
        [("y", t(91), 13, "end", True), ("z", t(34), 14, "too late", False)],
    ]
    got = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        out = I.idle_frames(stream, "task", "ts", "n", F.col("text"), F.col("done"), 600_000)
        q = out.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").format("parquet").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()  # each round is a restart from the checkpoint
        got.append({(r.task, r.at, r.kind, r.text) for r in spark.read.schema(out.schema).parquet(f"file://{tmp_path}/out").collect()})
    error = I.message(600_000)
    assert got[0] == {("a", t(0), "frame", "a0"), ("b", t(1), "frame", "b1"), ("c", t(2), "terminal", "c2"), ("d", t(0), "frame", "d0")}
    assert got[1] - got[0] == {("b", t(8), "frame", "b8"), ("z", t(30), "frame", "z"), ("a", t(10), "error", error), ("d", t(10), "error", error), ("b", t(18), "error", error)}
    assert got[2] - got[1] == {("z", t(33), "frame", "z33")}
    assert got[3] - got[2] == {("y", t(90), "frame", "y"), ("z", t(43), "error", error)}
    assert got[4] - got[3] == {("y", t(91), "terminal", "end")}
    every = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    batch = I.idle_frames_batch(every, "task", "ts", "n", F.col("text"), F.col("done"), 600_000, F.lit(t(91)).cast("timestamp"))
    kept_open = (got[4] - {("z", t(43), "error", error)}) | {("z", t(34), "frame", "too late"), ("z", t(44), "error", error)}  # a table has no late rows
    assert {(r.task, r.at, r.kind, r.text) for r in batch.collect()} == kept_open
