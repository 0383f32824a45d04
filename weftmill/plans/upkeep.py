"""Queries over upkeep: documents as sections and pages, events as frames, orders as sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.operators import upkeep as U
from weftmill.plans.registry import query, table

_MOST = 2000


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split_regex(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\n\n+') AS l FROM documents WHERE strlen(replace(coalesce(text, ''), chr(10), chr(10) || chr(10))) > {_MOST})),
g AS (SELECT doc_id, i, t, strlen(t) AS size, 0 AS piece FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.t, CASE WHEN g.size + strlen(p.t) > {_MOST} THEN strlen(p.t) ELSE g.size + strlen(p.t) END, g.piece + CAST(g.size + strlen(p.t) > {_MOST} AS INTEGER) FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, 'd' || CASE WHEN piece > 0 THEN ' (part ' || (piece + 1) || ')' ELSE '' END AS heading_path, string_agg(t, chr(10) || chr(10) ORDER BY i) AS markdown FROM g GROUP BY doc_id, piece
UNION ALL SELECT doc_id, 0, 'd', replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) FROM documents WHERE strlen(replace(coalesce(text, ''), chr(10), chr(10) || chr(10))) <= {_MOST}""")
def txt16_pieces(spark, sf_dir):
    """Whole texts as sections, cut at paragraphs (their lines) to pieces of two thousand bytes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("d").alias("heading_path"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("markdown"))
    return U.enforce_size(rows, _MOST)


@query("""WITH p AS (SELECT doc_id, 'wiki/' || lang || '/' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.md' END AS path, lang AS was, CASE doc_id % 3 WHEN 0 THEN [lang] WHEN 1 THEN ['old'] ELSE [] END AS history, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN 'Bad Topic' ELSE source || '/' || lang END AS to_ FROM documents),
o AS (SELECT *, CASE WHEN to_ = 'Bad Topic' THEN 'invalid topic' WHEN doc_id % 13 = 0 THEN 'invalid path' WHEN to_ = was THEN 'same topic' ELSE 'moved' END AS outcome FROM p)
SELECT path, outcome, CASE WHEN outcome = 'moved' THEN 'wiki/' || to_ || '/' || doc_id || '.md' END AS new_path, CASE WHEN outcome = 'moved' THEN to_ END AS topic,
  CASE WHEN outcome = 'moved' THEN CASE WHEN history[-1] IS DISTINCT FROM was THEN list_append(history, was) ELSE history END END AS topic_history FROM o""")
def mut9_moved_pages(spark, sf_dir):
    """Pages moved to other topics, with their new paths and histories."""
    k = F.col("doc_id")
    path = F.concat(F.lit("wiki/"), "lang", F.lit("/"), k, F.when(k % 13 == 0, ".txt").otherwise(".md"))
    history = F.when(k % 3 == 0, F.array("lang")).when(k % 3 == 1, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf_dir, "documents").withColumn("path", path)
    pages = d.select("path", F.col("lang").alias("topic"), history.alias("topic_history"))
    moves = d.select("path", F.when(k % 5 == 0, F.col("lang")).when(k % 5 == 1, "Bad Topic").otherwise(F.concat("source", F.lit("/"), "lang")).alias("topic"))
    return U.retopic(pages, moves, F.lit("2024-01-01")).drop("last_reviewed")


def _pages(spark, sf_dir):
    k = F.col("doc_id") % 7
    return table(spark, sf_dir, "documents").select(F.when(k == 0, F.lit(None)).when(k == 1, "").otherwise(F.concat_ws("/", "lang", "source")).alias("topic"), F.when(k > 2, F.col("lang")).when(k == 2, "").alias("type"))


@query("""WITH p AS (SELECT CASE WHEN doc_id % 7 > 1 THEN lang || '/' || source END AS topic, lang, source FROM documents)
SELECT lang AS path, lang AS name, CAST(0 AS INTEGER) AS depth, count(*) AS pages, 0 AS own FROM p WHERE topic IS NOT NULL GROUP BY lang
UNION ALL SELECT topic, source, 1, count(*), count(*) FROM p WHERE topic IS NOT NULL GROUP BY topic, source
UNION ALL SELECT 'untagged', 'Untagged', 0, count(*), count(*) FROM p WHERE topic IS NULL HAVING count(*) > 0""")
def agg12_topic_view(spark, sf_dir):
    """Folders of the topic view with their pages, and those without a topic."""
    return U.topic_tree(_pages(spark, sf_dir))


@query("SELECT 'view:type:' || CASE WHEN doc_id % 7 > 2 THEN lang ELSE 'other' END AS path, CASE WHEN doc_id % 7 > 2 THEN lang ELSE 'Other' END AS name, count(*) AS pages FROM documents GROUP BY ALL")
def agg12_type_view(spark, sf_dir):
    """Folders of the type view, and pages without a type."""
    return U.type_tree(_pages(spark, sf_dir))


@query("""WITH n AS (SELECT c_custkey AS owner, max(c_mktsegment) AS segment FROM customer GROUP BY ALL)
SELECT o_custkey AS owner, CAST(o_orderkey AS VARCHAR) AS session, CASE WHEN o_orderkey % 3 = 0 THEN left(trim(repeat(' ' || o_orderstatus || segment, 20)), 120) ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 <> 1 THEN 2 ELSE 1 END AS updated_at FROM orders LEFT JOIN n ON n.owner = o_custkey""")
def mut12_renamed_sessions(spark, sf_dir):
    """Sessions renamed (titles cut to 120 characters), touched, or given a blank title, which changes nothing."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").cast("string").alias("session"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("owner")).agg(F.max("c_mktsegment").alias("segment"))
    title = F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.concat(F.lit(" "), "o_orderstatus", "segment"), 20)).when(F.col("o_orderkey") % 3 == 1, "   ")
    changes = o.join(c, "owner").select("owner", "session", title.alias("title"))
    return U.rename(o.select("owner", "session", F.col("o_orderpriority").alias("title"), F.lit(1).alias("updated_at")), changes, F.lit(2))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT *, max(n) FILTER (event_type = 'signup') OVER w AS opened, max(n) FILTER (event_type IN ('purchase', 'error')) OVER w AS ended FROM f WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id FROM k WHERE event_type = 'signup' OR (opened IS NOT NULL AND (ended IS NULL OR ended < opened))""")
def str1_known_tasks(spark, sf_dir):
    """Frames of tasks that are known when they come: none before the task was opened, none after its end."""
    kind = F.col("event_type")
    return U.routed(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", kind == "signup", kind.isin("purchase", "error")).select("user_id", "event_id")
