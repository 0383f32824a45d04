"""Queries over streams of frames (events: the user is the task), in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.plans.registry import query, table
from weftmill.scratch import folder
from weftmill.streaming import frames as S
from weftmill.streaming import idle as I


def _base(spark) -> str:
    """A folder for stream state that all executors share."""
    return folder(spark, "stream")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, coalesce(max(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM events) WHERE over_ = 0")
def str1_routing(spark, sf_dir):
    """Frames up to the end of their task."""
    return S.route(_events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g) SELECT user_id, count(*) AS frames, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY user_id, n""")
def str2_idle(spark, sf_dir):
    """Runs of frames that end after six idle hours."""
    return S.idle_sessions(_events(spark, sf_dir), "user_id", "ts", "6 hours")


@query("SELECT user_id, string_agg(event_type || ';', '' ORDER BY ts, event_id) AS text FROM (SELECT *, max(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM events) WHERE stopped = 0 GROUP BY user_id")
def str4_assembled(spark, sf_dir):
    """Text joined up to the frame that stops it."""
    return S.assembled(_events(spark, sf_dir), "user_id", "ts", "event_id", F.concat("event_type", F.lit(";")), F.col("event_type") == "error")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role || ' ' || turn AS event FROM conversations")
def str5_events(spark, sf_dir):
    """Server-sent events put together from pieces cut at odd places."""
    rows = table(spark, sf_dir, "conversations")
    event = F.concat(F.lit("id: 1\ndata: "), "role", F.lit(" "), "turn", F.lit("\n\n"))
    pieces = rows.select("conv_id", F.explode(F.array(F.struct((F.col("turn") * 2).alias("n"), F.substring(event, 1, 9).alias("piece")), F.struct((F.col("turn") * 2 + 1).alias("n"), F.substring(event, 10, 999).alias("piece")))).alias("p"))
    return S.reassemble(pieces.select("conv_id", "p.n", "p.piece"), "conv_id", "n", "piece")


_LATEST = "SELECT user_id, count(*) AS frames, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id"


@query(_LATEST)
def str6_latest(spark, sf_dir):
    """The latest state of each task."""
    return S.latest_state(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type")


@query(_LATEST)
def str6_latest_stream(spark, sf_dir):
    """The same as a stream in complete mode."""
    return S.drained(S.latest_state(S.stream_of(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type"), "complete", _base(spark))


_RATE = """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, ts AS last, ts, event_id, true AS ok FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.ts - f.last >= INTERVAL 1 DAY THEN e.ts ELSE f.last END, e.ts, e.event_id, e.ts - f.last >= INTERVAL 1 DAY FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) """


@query(_RATE + "SELECT user_id, ts AS at, event_id FROM f WHERE ok")
def str9_rate_limit(spark, sf_dir):
    """Events at least a day after the last accepted one."""
    return S.rate_limited(_events(spark, sf_dir), "user_id", "ts", "event_id", 86400).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(_RATE + "SELECT user_id, ts AS at FROM f WHERE ok")
def str9_rate_limit_stream(spark, sf_dir):
    """The same as a stream with state for each key."""
    stream = S.stream_of(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return S.drained(S.rate_limited_stream(stream, "user_id", "at", 86400), "append", _base(spark)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_stream(spark, sf_dir):
    """Extension: tumbling windows with a watermark, as a stream."""
    stream = S.stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days")
    agg = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return S.drained(agg.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total"), "complete", _base(spark))


@query("SELECT day, n FROM (SELECT d AS day, count(e.event_id) AS n FROM (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) AS d FROM events UNION SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY FROM events) LEFT JOIN events e ON e.ts >= d AND e.ts < d + INTERVAL 2 DAY GROUP BY d) WHERE n > 0")
def ext_sliding(spark, sf_dir):
    """Extension: two-day windows that slide by a day."""
    w = F.window(F.col("ts").cast("timestamp"), "2 days", "1 day")
    return _events(spark, sf_dir).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS connection, count(*) - 1 AS superseded FROM events WHERE event_type = 'signup' GROUP BY user_id")
def str3_supersede(spark, sf_dir):
    """The newest connection of an agent; older ones are superseded."""
    return _events(spark, sf_dir).where("event_type = 'signup'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("connection"), (F.count("*") - 1).alias("superseded"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def str10_retry(spark, sf_dir):
    """Only failed stages run again."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


_IDLE = """WITH f AS (SELECT user_id, ts, event_id, event_type = 'error' AS terminal, coalesce(lead(ts) OVER w, (SELECT max(ts) FROM events)) - ts >= INTERVAL 6 HOUR AND event_type <> 'error' AS idle FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
o AS (SELECT *, coalesce(max(CAST(terminal OR idle AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM f)
SELECT user_id AS task, ts AS at, CASE WHEN terminal THEN 'terminal' ELSE 'frame' END AS kind, CAST(event_id AS VARCHAR) AS text FROM o WHERE closed = 0
UNION ALL SELECT user_id, date_trunc('millisecond', ts) + INTERVAL 6 HOUR, 'error', 'task idle timeout: no agent activity for 21600000ms' FROM o WHERE closed = 0 AND idle"""


@query(_IDLE)
def str2_idle_errors(spark, sf_dir):
    """Frames of open tasks, and an error for each that was idle for six hours."""
    rows = _events(spark, sf_dir)
    until = rows.agg(F.max("ts").cast("timestamp").alias("n")).scalar()
    out = I.idle_frames_batch(rows, "user_id", "ts", "event_id", F.col("event_id").cast("string"), F.col("event_type") == "error", 21_600_000, until)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(_IDLE)
def str2_idle_errors_stream(spark, sf_dir):
    """The same as a stream whose errors come from timers."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, I.PROVIDER)  # timers need it; the stream takes its settings at its start
    try:
        stream = S.stream_of(spark, sf_dir, "events")
        out = I.idle_frames(stream, "user_id", "ts", "event_id", F.col("event_id").cast("string"), F.col("event_type") == "error", 21_600_000, forget_ms=10 * 365 * 86_400_000)
        return S.drained(out, "append", _base(spark)).withColumn("at", F.col("at").cast("timestamp_ntz"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
