"""Chat sessions and context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmill.functions.text import token_estimate


def session_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their message count; an empty session has none."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    return sessions.join(n, "session_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def list_sessions(sessions: DataFrame, messages: DataFrame, limit: int = 10) -> DataFrame:
    """The latest sessions of each employee, with the legacy messages (session id '') as one virtual session."""
    legacy = messages.where("session_id = ''").groupBy("employee_id").agg(F.count("*").alias("messages"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    own = session_counts(sessions, messages).select("employee_id", "session_id", "created_at", "updated_at", "messages")
    rows = own.unionByName(legacy.select("employee_id", F.lit("").alias("session_id"), "created_at", "updated_at", "messages"))
    w = Window.partitionBy("employee_id").orderBy(F.desc("updated_at"), F.desc("created_at"), "session_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(1, min(100, limit)))


def prune(sessions: DataFrame, keep: int = 10) -> DataFrame:
    """The sessions of each employee beyond the latest ``keep`` (1 to 100)."""
    w = Window.partitionBy("employee_id").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("session_id"))
    return sessions.withColumn("n", F.row_number().over(w)).where(F.col("n") > max(1, min(100, keep))).drop("n")


def recent(messages: DataFrame, key: str, order: str, limit: int = 200) -> DataFrame:
    """The latest messages of each session; rank-limited before the exchange."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(1, min(1000, limit))).drop("n")


def context(turns: DataFrame, key: str, order: str, line: str, budget: int = 200_000, keep: int = 40) -> DataFrame:
    """What goes to a model: every turn while the budget holds, else a note in place of all but the last ``keep``."""
    total = turns.groupBy(key).agg(F.sum(token_estimate(F.col(line))).alias("tokens"), F.count("*").alias("turns"))
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rows = turns.withColumn("back", F.row_number().over(w)).join(total, key)
    cut = (F.col("tokens") > budget) & (F.col("turns") > keep)
    kept = rows.where(~cut | (F.col("back") <= keep)).select(key, order, line)
    note = total.where(cut).select(key, (F.lit(-1)).cast(dict(turns.dtypes)[order]).alias(order), F.lit("[earlier turns omitted]").alias(line))
    return kept.unionByName(note)
