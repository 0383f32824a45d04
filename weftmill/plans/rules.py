"""Queries over rules: topics, types, lifecycle, states, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.functions import rules as R
from weftmill.plans.registry import query, table


def _word(p: str) -> str:
    return r"\b(?:" + p + r")\b"


def _ordered(x: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{_word(p)}') THEN '{v}'" for p, v in rules) + f" ELSE {default} END"


#: A title for each order, so that rules have something to match.
_SUBJECTS = ("BTP rollout workshop", "Group Reporting manual", "ABAP interface specification", "annual report on consolidation", "contract for S/4HANA client", "ui5 training material", "plain note", "esg policy", "meeting minutes datasphere", "roadmap for bw planning")
_TITLE_SQL = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUBJECTS)) + " END"
_CLASS_SQL = f"SELECT *, lower(title || chr(10) || o_orderpriority) AS hay FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, {_TITLE_SQL} AS title FROM orders)"


def _orders(spark, sf_dir):
    title = F.element_at(F.array(*[F.lit(s) for s in _SUBJECTS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "orders").withColumn("title", title)


@query(f"SELECT o_orderkey, {_ordered('hay', R.TOPICS, 'NULL')} AS topic, {_ordered('hay', R.TYPES, chr(39) + 'concept' + chr(39))} AS type FROM ({_CLASS_SQL})")
def dt5_dt6_classify(spark, sf_dir):
    """Local topic and type of titles; first rule wins."""
    t, c = F.col("title"), F.col("o_orderpriority")
    return _orders(spark, sf_dir).select("o_orderkey", R.local_topic(t, c).alias("topic"), R.local_type(t, c).alias("type"))


@query(f"""SELECT o_orderkey, category, topic, 'wiki/' || CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.TYPE_DIRS.items())} END || '/' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') || '.md' AS page_path
FROM (SELECT o_orderkey, title, CASE WHEN o_orderkey % 3 = 0 THEN 'event' ELSE {_ordered('hay', R.TYPES, chr(39) + 'concept' + chr(39))} END AS category, CASE WHEN o_orderkey % 4 = 0 THEN 'a/b-c' ELSE {_ordered('hay', R.TOPICS, 'NULL')} END AS topic FROM ({_CLASS_SQL}))""")
def dt7_dt8_page_path(spark, sf_dir):
    """Given classification where valid, else the local one; and the page path."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "event").otherwise("nonsense")
    topic = F.when(F.col("o_orderkey") % 4 == 0, "a/b-c").otherwise("Not Valid")
    c = R.classify(kind, topic, F.col("title"), F.col("o_orderpriority"))
    return _orders(spark, sf_dir).select("o_orderkey", c.alias("c")).select("o_orderkey", "c.*")


_AGE = "greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-09-01'))"
_REVIEW = f"""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS reads, (o_orderkey % 11) / 10.0::DOUBLE AS c, {_AGE} AS age, o_orderkey % 5 = 0 AS moves, o_orderkey % 7 = 0 AS retypes, o_orderkey % 3 = 0 AS fresh FROM orders),
f AS (SELECT *, least(1.0, greatest(0.0, c - age * 0.001::DOUBLE)) AS faded FROM o),
v AS (SELECT *, CASE WHEN moves THEN 'retopic' WHEN retypes THEN 'reclassify' WHEN age >= 180 AND reads < 3 THEN 'deprecate' WHEN fresh THEN 'reinforce' WHEN faded < c - 1e-9 THEN 'deprecate' ELSE 'none' END AS action,
  CASE WHEN moves OR retypes THEN faded WHEN age >= 180 AND reads < 3 THEN faded * 0.5::DOUBLE WHEN fresh THEN least(1.0, faded + 0.15::DOUBLE) ELSE faded END AS value FROM f)
SELECT o_orderkey, action, floor(value * 1000 + 0.5) / 1000 AS confidence, floor((value - c) * 1000 + 0.5) / 1000 AS delta, NOT moves AND NOT retypes AND age >= 180 AND reads < 3 AND value <= 0.3 AS archive FROM v"""


def _review(spark, sf_dir):
    k = F.col("o_orderkey")
    r = R.review(
        (k % 11 / 10).cast("double"), k % 6, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998-09-01"), F.lit("a/b"), F.when(k % 5 == 0, "a/c").otherwise("a/b"), F.lit("report"), F.when(k % 7 == 0, " Manual ").otherwise("report"), k % 3 == 0
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.*")


@query(_REVIEW)
def dt2_review(spark, sf_dir):
    """Lifecycle decisions: retopic, reclassify, deprecate, reinforce, fade."""
    return _review(spark, sf_dir)


@query(f"SELECT count(*) AS scanned, count(*) FILTER (action <> 'none') AS changed, count(*) FILTER (archive) AS archived FROM ({_REVIEW})")
def agg10_review_report(spark, sf_dir):
    """How many pages a review saw, changed and archived."""
    return _review(spark, sf_dir).agg(F.count("*").alias("scanned"), F.count_if(F.col("action") != "none").alias("changed"), F.count_if("archive").alias("archived"))


@query(f"SELECT o_orderkey, {_AGE} AS days FROM orders")
def dt1_days_between(spark, sf_dir):
    """Whole days to a date, never negative."""
    return table(spark, sf_dir, "orders").select("o_orderkey", R.days_between(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998-09-01")).cast("long").alias("days"))


@query("SELECT event_id, floor(least(1.0, greatest(0.0, (event_id % 21) / 20.0::DOUBLE + CASE WHEN event_type IN ('click', 'purchase') THEN 0.15 ELSE -0.15 END)) * 1000 + 0.5) / 1000 AS confidence FROM events")
def dt3_feedback_step(spark, sf_dir):
    """One step of feedback on a confidence."""
    d = F.when(F.col("event_type").isin("click", "purchase"), "up").otherwise("down")
    return table(spark, sf_dir, "events").select("event_id", R.adjust_confidence((F.col("event_id") % 21 / 20).cast("double"), d).alias("confidence"))


@query("""WITH s AS (SELECT user_id, max(ts) AS seen, bool_or(event_type = 'signup') AS registered FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN registered AND date_diff('second', seen, TIMESTAMP '2024-01-31 00:00:00') <= 86400 THEN 'reachable' WHEN registered THEN 'registered' WHEN user_id % 2 = 0 THEN 'invited' ELSE 'unknown' END AS status FROM s""")
def dt4_reachability(spark, sf_dir):
    """Who is reachable, from the last sign of each user."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), F.bool_or(F.col("event_type") == "signup").alias("registered"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return s.select("user_id", R.reachability(F.col("registered"), F.col("seen"), F.col("user_id") % 2 == 0, now, 86400).alias("status"))


_EDGES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}', '{t}', '{w}')" for k, edges in (("ticket", R.TICKET_EDGES), ("spec", R.SPEC_EDGES)) for a, b, t, w in edges) + ") AS e(kind, source, target, transition, actor)"


@query(f"WITH e AS ({_EDGES_SQL}) SELECT target, kind, count(*) AS ways, array_to_string(list_sort(list(source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT actor)), ',') AS actors FROM e GROUP BY target, kind")
def dt9_transitions(spark, sf_dir):
    """The state machines as edges: from where a state is reached, and who moves it."""
    from weftmill.operators.board import transitions

    e = transitions(spark).groupBy("target", "kind")
    return e.agg(F.count("*").alias("ways"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("actors"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'done' END AS p, CASE o_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END AS r, CASE o_orderkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'running' END AS w, CASE o_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'running' END AS g FROM orders)
SELECT o_orderkey, CASE WHEN p <> 'done' THEN CASE p WHEN 'failed' THEN 100 ELSE 15 END WHEN r <> 'done' THEN CASE r WHEN 'failed' THEN 100 ELSE 35 END WHEN w = 'done' AND g = 'done' THEN 100 WHEN w = 'done' THEN CASE g WHEN 'failed' THEN 100 ELSE 88 END WHEN g = 'done' THEN CASE w WHEN 'failed' THEN 100 ELSE 72 END WHEN w = 'failed' OR g = 'failed' THEN 100 ELSE 50 END AS progress FROM s""")
def agg15_progress(spark, sf_dir):
    """Overall progress from four stage states."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.when(k % 4 == 1, "failed").when(k % 4 == 2, "running").otherwise("done")
    r = F.when(c % 4 == 0, "failed").when(c % 4 == 1, "running").otherwise("done")
    three = lambda x: F.when(x % 3 == 0, "done").when(x % 3 == 1, "failed").otherwise("running")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.overall_progress(p, r, three(k), three(c)).alias("progress"))


@query("SELECT s_suppkey, 'code/' || lower(s_name) AS topic FROM (SELECT s_suppkey, regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s_name FROM supplier)")
def utf7_code_topic(spark, sf_dir):
    """Topic of a code system."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.code_topic(F.col("s_name")).alias("topic"))
