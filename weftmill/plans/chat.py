"""Queries over chat sessions, windows and task boards of messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftmill.operators import chat as H
from weftmill.plans.registry import query, table

_MSG = "SELECT user_id AS employee_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) || '-' || user_id END AS session_id, ts AS created_at, event_id FROM events"
_SES = f"SELECT employee_id, session_id, min(created_at) AS created_at, max(created_at) AS updated_at FROM ({_MSG}) WHERE session_id <> '' GROUP BY ALL"


def _messages(spark, sf_dir):
    s = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat_ws("-", F.to_date("ts"), "user_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("employee_id"), s.alias("session_id"), F.col("ts").alias("created_at"), "event_id")


def _sessions(spark, sf_dir):
    return _messages(spark, sf_dir).where("session_id <> ''").groupBy("employee_id", "session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


@query(f"SELECT s.session_id, count(m.event_id) AS messages FROM ({_SES}) s LEFT JOIN ({_MSG}) m ON m.session_id = s.session_id AND m.event_id % 2 = 0 GROUP BY s.session_id")
def jn1_session_counts(spark, sf_dir):
    """Messages of each session, none for an empty one."""
    return H.session_counts(_sessions(spark, sf_dir), _messages(spark, sf_dir).where("event_id % 2 = 0")).select("session_id", "messages")


@query(f"""SELECT employee_id, session_id, messages, n FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY updated_at DESC, created_at DESC, session_id) AS n FROM (
SELECT s.employee_id, s.session_id, s.created_at, s.updated_at, count(m.event_id) AS messages FROM ({_SES}) s LEFT JOIN ({_MSG}) m USING (session_id) GROUP BY ALL
UNION ALL SELECT employee_id, '', min(created_at), max(created_at), count(*) FROM ({_MSG}) WHERE session_id = '' GROUP BY employee_id)) WHERE n <= 5""")
def srt12_list_sessions(spark, sf_dir):
    """The five latest sessions of each employee, the virtual one included."""
    return H.list_sessions(_sessions(spark, sf_dir), _messages(spark, sf_dir), 5).select("employee_id", "session_id", "messages", "n")


@query(f"SELECT employee_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY updated_at DESC, created_at DESC, session_id DESC) AS n FROM ({_SES})) WHERE n > 10")
def win1_prune(spark, sf_dir):
    """Sessions beyond the latest ten of an employee."""
    return H.prune(_sessions(spark, sf_dir)).select("employee_id", "session_id")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def win2_recent(spark, sf_dir):
    """The three latest turns of each conversation."""
    return H.recent(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


_LINE = "SELECT conv_id, turn, role || ': ' || text AS line FROM conversations"


@query(f"""WITH l AS ({_LINE}), t AS (SELECT conv_id, sum(CAST(ceil(length(line) / 4.0) AS BIGINT)) AS tokens, count(*) AS turns FROM l GROUP BY conv_id), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM l)
SELECT r.conv_id, r.turn, r.line FROM r JOIN t USING (conv_id) WHERE NOT (tokens > 150 AND turns > 2) OR back <= 2 UNION ALL SELECT conv_id, -1, '[earlier turns omitted]' FROM t WHERE tokens > 150 AND turns > 2""")
def str11_context(spark, sf_dir):
    """Conversations cut to a token budget."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return H.context(rows, "conv_id", "turn", "line", 150, 2)


@query(f"SELECT employee_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM ({_MSG}) WHERE session_id = '' GROUP BY employee_id")
def agg1_legacy(spark, sf_dir):
    """Count and span of legacy messages."""
    return _messages(spark, sf_dir).where("session_id = ''").groupBy("employee_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("SELECT conv_id, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM conversations GROUP BY conv_id")
def agg16_tokens(spark, sf_dir):
    """Estimated tokens of each conversation."""
    from weftmill.functions.text import token_estimate

    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))


@query("SELECT conv_id, turn, role AS parent, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS child FROM conversations")
def win9_pairs(spark, sf_dir):
    """Parent and child along a chain."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("parent"), F.lead("role").over(w).alias("child"))


@query("""WITH w AS (SELECT user_id, event_id, ts, row_number() OVER o AS processed, count(*) OVER (PARTITION BY user_id) AS total, first_value(ts) OVER o AS anchor FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN ts > anchor THEN round((total - processed) * (epoch_us(ts) - epoch_us(anchor)) / 1000.0::DOUBLE / processed, 3) END AS eta_ms FROM w""")
def win8_rolling_eta(spark, sf_dir):
    """Time left, from the pace since the anchor."""
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.row_number().over(o).alias("processed"), F.count("*").over(Window.partitionBy("user_id")).alias("total"), F.first("ts").over(o).alias("anchor"))
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("anchor").cast("timestamp"))) / 1000.0
    return rows.select("user_id", "event_id", F.when(F.col("ts") > F.col("anchor"), F.round((F.col("total") - F.col("processed")) * ms / F.col("processed"), 3)).alias("eta_ms"))
