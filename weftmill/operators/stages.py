"""Retrying stages of tasks, and connections that supersede each other.

A retry restarts the failed stages and, through the graph of stages, everything that depends on one of them, and nothing else. The
closure over the graph is a fixed small table (stages times stages, made on the driver from the graph), so the work on tasks is one
join with it and one aggregate.

A task that is still running is busy, one without a failed stage has nothing to retry; unknown stages are dropped; repeated
rows of a stage count once, the last by ``at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The stages of an ingest task, in order, each with those it needs; any other graph can be given.
STAGES = {"parsing": (), "refinement": ("parsing",), "ingesting_wiki": ("refinement",), "ingesting_graph": ("refinement",)}


def closure(spark: SparkSession, needs: dict[str, tuple[str, ...]] = STAGES) -> DataFrame:
    """``failed, stage, place``: what runs again if ``failed`` does, itself included; raises if the graph has a cycle."""
    order, seen = [], set()

    def visit(name: str, path: tuple[str, ...] = ()) -> None:
        if name in path:
            raise ValueError(f"stages depend on each other: {' -> '.join((*path, name))}")
        if name not in seen:
            for n in needs.get(name, ()):
                visit(n, (*path, name))
            seen.add(name)
            order.append(name)

    for name in needs:
        visit(name)
    above: dict[str, set[str]] = {}
    for name in order:
        above[name] = {name}.union(*(above[n] for n in needs.get(name, ())))
    return spark.createDataFrame([(f, s, i) for i, s in enumerate(order) for f in above[s]], "failed string, stage string, place int")


def retry(stages: DataFrame, needs: dict[str, tuple[str, ...]] = STAGES) -> DataFrame:
    """``task, outcome, restarted`` of stage states (task, stage, status, at); restarted stages are in order."""
    w = Window.partitionBy("task", "stage").orderBy(F.desc("at"), "status")
    last = stages.withColumn("n_", F.row_number().over(w)).where("n_ = 1")
    verdict = last.groupBy("task").agg(F.bool_or(F.col("status").isin("running", "pending")).alias("busy"), F.bool_or(F.col("status") == "failed").alias("failed"))
    reach = closure(stages.sparkSession, needs).withColumnRenamed("stage", "restage")
    again = last.where("status = 'failed'").join(reach, F.col("stage") == F.col("failed")).select("task", "restage", "place")
    listed = again.groupBy("task").agg(F.array_sort(F.collect_set(F.struct("place", "restage"))).alias("r"))  # at most all stages
    outcome = F.when(F.col("busy"), "busy").when(~F.col("failed"), "nothing").otherwise("retried")
    rows = verdict.join(listed, "task", "left")
    return rows.select("task", outcome.alias("outcome"), F.when(outcome == "retried", F.transform("r", lambda x: x["restage"])).otherwise(F.array().cast("array<string>")).alias("restarted"))


def superseded(frames: DataFrame) -> DataFrame:
    """``task, agent, connection, outcome, at`` of tasks (frames: agent, at, tie, kind, connection, task).

    A frame of kind ``register`` opens an agent's connection and ends its one before; tasks that were dispatched over that one and
    have neither completed nor failed by then fail with the reason. A frame of a task counts for the connection in force when it was sent.
    """
    w = Window.partitionBy("agent").orderBy("at", "tie")
    numbered = frames.withColumn("era", F.sum((F.col("kind") == "register").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = numbered.where("kind = 'register'").select("agent", "era", "connection", "at")
    ends = start.select("agent", (F.col("era") - 1).alias("era"), F.col("at").alias("ended"))
    tasks = numbered.where("task is not null and era > 0").groupBy("agent", "era", "task").agg(
        F.min_by(F.when(F.col("kind").isin("complete", "error"), F.struct("kind", "at")), F.when(F.col("kind").isin("complete", "error"), F.struct("at", "tie"))).alias("end"),
        F.max((F.col("kind") == "dispatch").cast("int")).alias("sent"),
    )
    rows = tasks.where("sent = 1").join(start.select("agent", "era", "connection"), ["agent", "era"]).join(ends, ["agent", "era"], "left")
    outcome = F.when(F.col("end").isNotNull(), F.col("end.kind")).when(F.col("ended").isNotNull(), "superseded").otherwise("open")
    return rows.select("task", "agent", "connection", outcome.alias("outcome"), F.coalesce("end.at", "ended").alias("at"))
