"""Agent frames as streams: routing, idle time, text assembly, rate limits, progress. Each has a batch form, and the
stateful ones a Structured Streaming form with the same rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def route(frames: DataFrame, key: str, at: str, tie: str, terminal: Column) -> DataFrame:
    """Frames up to the first terminal one of their task; later ones are dropped."""
    w = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("over", F.coalesce(F.max(terminal).over(w), F.lit(False))).where(~F.col("over")).drop("over")


def idle_sessions(frames: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of frames with less than ``gap`` between them; a run that ends is a timeout."""
    return frames.groupBy(key, F.session_window(F.col(at).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("frames"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).drop("w")


def assembled(frames: DataFrame, key: str, at: str, tie: str, text: Column, stop: Column) -> DataFrame:
    """Text deltas joined in order up to the first frame that stops the stream."""
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = frames.withColumn("stopped", F.max(stop).over(w)).where(~F.col("stopped"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at), F.col(tie), text.alias("text"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def rate_limited(events: DataFrame, key: str, at: str, tie: str, seconds: float) -> DataFrame:
    """Which events are accepted: those at least ``seconds`` after the last accepted one of their key.

    A fold over each key's events in order, as the rule depends on what was accepted, not on what came.
    """
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("timestamp").alias("at"), F.col(tie).alias("tie")))).alias("all"))
    micros = lambda c: F.unix_micros(c)
    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.slice(F.col("all"), 1, 0).alias("taken"))

    def step(acc: Column, e: Column) -> Column:
        ok = acc["last"].isNull() | (micros(e["at"]) - micros(acc["last"]) >= int(seconds * 1e6))
        return F.struct(F.when(ok, e["at"]).otherwise(acc["last"]).alias("last"), F.when(ok, F.array_append(acc["taken"], e)).otherwise(acc["taken"]).alias("taken"))

    taken = rows.select(key, F.explode(F.aggregate("all", start, step, lambda a: a["taken"])).alias("e"))
    return taken.select(key, F.col("e.at").alias("at"), F.col("e.tie").alias(tie))


def latest_state(frames: DataFrame, key: str, at: str, tie: str, state: str) -> DataFrame:
    """Frames seen, and the latest state, of each task."""
    return frames.groupBy(key).agg(F.count("*").alias("frames"), F.max_by(state, F.struct(at, tie)).alias("state"))


def reassemble(pieces: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Server-sent events out of text pieces that were cut anywhere: ``key, seq, event``."""
    whole = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("whole"))
    blocks = whole.select(key, F.posexplode(F.split("whole", "\n\n")).alias("seq", "block"))
    data = F.array_join(F.transform(F.filter(F.split("block", "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30))), "\n")
    return blocks.select(key, "seq", data.alias("event")).where("event <> ''")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def drained(stream: DataFrame, mode: str, base: str) -> DataFrame:
    """Run a stream over what there is, and return what the last state of its sink holds."""
    spark, schema = stream.sparkSession, stream.schema

    def sink(rows: DataFrame, epoch: int) -> None:  # a batch that is run again writes the same folder again
        rows.write.mode("overwrite").parquet(f"{base}/out/epoch={0 if mode == 'complete' else epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)


def rate_limited_stream(stream: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """The streaming form of :func:`rate_limited`: the last accepted time is the state of a key."""
    schema = stream.select(key, at).schema

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at)
        taken = []
        for t in rows[at]:
            micros = int(pd.Timestamp(t).value // 1000)
            if last is None or micros - last >= seconds * 1e6:
                taken.append(t)
                last = micros
        state.update((last,))
        yield pd.DataFrame({key: [group[0]] * len(taken), at: taken})

    return stream.select(key, at).groupBy(key).applyInPandasWithState(step, schema, "last long", "append", "NoTimeout")
