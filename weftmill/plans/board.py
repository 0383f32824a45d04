"""Queries over the task board. Orders stand for tickets: goal by customer's nation, spec by customer, blockers by key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftmill.operators import board as B
from weftmill.plans.registry import query, table

_STATUS = "CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'approved' END WHEN 'O' THEN 'backlog' ELSE 'in_progress' END"
_REF = "'G1.S' || o_custkey || '.T' || o_orderkey"
_TICKETS = f"SELECT o_orderkey, {_REF} AS ref, 'G1.S' || o_custkey AS parent, {_STATUS} AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'ada' ELSE '' END AS assignee, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_custkey, o_orderpriority FROM orders"
_BLOCK = f"SELECT ref, 'G1.S' || o_custkey || '.T' || before AS blocker, before AS k FROM ({_TICKETS}) WHERE before IS NOT NULL UNION ALL SELECT ref, 'G9.S9.T9', NULL FROM ({_TICKETS}) WHERE o_orderkey % 100 = 1"
_OPEN = f"SELECT b.ref, b.blocker FROM ({_BLOCK}) b LEFT JOIN ({_TICKETS}) t ON t.ref = b.blocker WHERE NOT coalesce(t.status IN ('done', 'approved'), false)"


def _tickets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "done").otherwise("approved")).when(F.col("o_orderstatus") == "O", "backlog").otherwise("in_progress")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    spec = F.concat(F.lit("G1.S"), "o_custkey")
    o = o.withColumn("before", before)
    blocked = F.array_compact(F.array(F.concat(spec, F.lit(".T"), F.col("before")), F.when(F.col("o_orderkey") % 100 == 1, "G9.S9.T9")))
    return o.select("o_orderkey", F.concat(spec, F.lit(".T"), "o_orderkey").alias("ref"), spec.alias("parent"), status.alias("status"), F.when(F.col("o_orderkey") % 5 == 0, "ada").otherwise("").alias("assignee"), blocked.alias("blocked_by"), "o_orderpriority", "o_custkey")


@query(f"SELECT ref FROM ({_TICKETS}) WHERE status = 'backlog' AND assignee = '' AND ref NOT IN (SELECT ref FROM ({_OPEN}))")
def jn11_claimable(spark, sf_dir):
    """Tickets to dispatch: backlog, unassigned, no open blocker; a missing blocker is open."""
    return B.claimable(_tickets(spark, sf_dir)).select("ref")


@query(f"SELECT ref, list_sort(list(blocker)) AS open_blockers FROM ({_OPEN}) GROUP BY ref")
def jn12_unresolved(spark, sf_dir):
    """Open blockers of each ticket."""
    return B.unresolved(_tickets(spark, sf_dir))


@query(f"SELECT ref FROM ({_TICKETS}) WHERE status = 'backlog' AND assignee = '' AND ref NOT IN (SELECT ref FROM ({_OPEN})) ORDER BY o_custkey, o_orderkey LIMIT 1")
def srt11_first_claimable(spark, sf_dir):
    """The next ticket in natural order (a top-1 report)."""
    return B.claimable(_tickets(spark, sf_dir)).orderBy(*B.natural(F.col("ref"))).limit(1).select("ref")


@query(f"SELECT ref, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position FROM ({_TICKETS})")
def srt6_natural_order(spark, sf_dir):
    """Natural numeric order of all references."""
    rows = _tickets(spark, sf_dir)
    return B.positions(rows.select("ref"), [F.regexp_extract("ref", rf"{c}(\d+)", 1).try_cast("long") for c in "GST"]).select("ref", "position")


@query(f"SELECT parent, count(*) FILTER (status IN ('done', 'approved')) AS done, count(*) AS total, CAST(floor(count(*) FILTER (status IN ('done', 'approved')) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS percent FROM ({_TICKETS}) GROUP BY parent")
def agg8_roll_up(spark, sf_dir):
    """Done, total and percent of each spec's tickets."""
    return B.roll_up(_tickets(spark, sf_dir))


@query(f"SELECT max(o_orderkey) + 1 AS next, parent FROM ({_TICKETS}) GROUP BY parent")
def agg14_next_ref(spark, sf_dir):
    """The next free ticket number of each spec."""
    return B.next_number(_tickets(spark, sf_dir), "T", by="parent")


@query("""WITH c AS (SELECT o_orderkey AS pos, CASE o_orderpriority WHEN '1-URGENT' THEN 'Done' WHEN '2-HIGH' THEN 'Backlog' WHEN '3-MEDIUM' THEN 'Someday' ELSE 'In Review' END AS status, 'r' || o_orderkey AS ref FROM orders),
g AS (SELECT status, min(pos) AS seen FROM c GROUP BY status),
o AS (SELECT row_number() OVER (ORDER BY CASE status WHEN 'Backlog' THEN 1 WHEN 'Done' THEN 3 WHEN 'In Review' THEN 4 ELSE 1000 END, seen) AS ordinal, status FROM g)
SELECT ordinal, status, row_number() OVER (PARTITION BY status ORDER BY pos) - 1 AS position, ref FROM c JOIN o USING (status)""")
def agg9_columns(spark, sf_dir):
    """Board columns in their order with all their cards, one row a card."""
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "Done").when(p == "2-HIGH", "Backlog").when(p == "3-MEDIUM", "Someday").otherwise("In Review")
    return B.column_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), status.alias("status"), F.concat(F.lit("r"), "o_orderkey").alias("ref")))


_CARDS = f"SELECT ref || CASE WHEN o_orderkey % 3 = 0 THEN ': title' ELSE '' END AS title, ref, status, CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'in_review' END AS wanted FROM ({_TICKETS}) WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"


@query(f"""SELECT title, ref, status, wanted, CASE WHEN wanted IS NULL THEN 'unknown_option' WHEN status = wanted THEN 'unchanged' WHEN (status, wanted) IN (('backlog', 'in_progress'), ('in_progress', 'done'), ('in_progress', 'in_review'), ('done', 'in_review')) THEN 'apply' ELSE 'conflict' END AS verdict FROM ({_CARDS})
UNION ALL SELECT 'G8.S8.T8 lost', 'G8.S8.T8', NULL, 'done', 'unknown_ticket'""")
def jn15_status_pull(spark, sf_dir):
    """Tickets against project cards: apply, unchanged, conflict, unknown."""
    t = _tickets(spark, sf_dir)
    k = F.col("o_orderkey") % 4
    cards = t.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").select(F.concat("ref", F.when(F.col("o_orderkey") % 3 == 0, ": title").otherwise("")).alias("title"), F.when(k == 0, "Done").when(k == 1, "In Progress").when(k == 2, "In Review").otherwise("Elsewhere").alias("option"))
    return B.pull_status(t, cards.unionByName(spark.createDataFrame([("G8.S8.T8 lost", "Done")], cards.schema)))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS accepted FROM events")
def str8_first_claim(spark, sf_dir):
    """The first claim of each ticket wins."""
    return B.first_claims(table(spark, sf_dir, "events").withColumnRenamed("user_id", "ref")).select(F.col("ref").alias("user_id"), "event_id", "accepted")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'in_progress' WHEN 'click' THEN 'done' WHEN 'view' THEN 'in_review' WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS target FROM events),
m(a, b) AS (VALUES ('backlog', 'in_progress'), ('in_progress', 'done'), ('in_progress', 'in_review'), ('done', 'in_review'), ('in_review', 'approved'), ('in_review', 'rejected')),
f AS (SELECT user_id, seq, 'backlog' AS source, target, ('backlog', target) IN (SELECT (a, b) FROM m) AS accepted FROM e WHERE seq = 1
 UNION ALL SELECT e.user_id, e.seq, CASE WHEN f.accepted THEN f.target ELSE f.source END, e.target, (CASE WHEN f.accepted THEN f.target ELSE f.source END, e.target) IN (SELECT (a, b) FROM m) FROM f JOIN e ON e.user_id = f.user_id AND e.seq = f.seq + 1)
SELECT user_id, seq, source, target, accepted FROM f""".replace("('backlog', target) IN (SELECT (a, b) FROM m)", "target = 'in_progress'").replace("(CASE WHEN f.accepted THEN f.target ELSE f.source END, e.target) IN (SELECT (a, b) FROM m)", "CASE WHEN f.accepted THEN f.target ELSE f.source END || '>' || e.target IN ('backlog>in_progress', 'in_progress>done', 'in_progress>in_review', 'done>in_review', 'in_review>approved', 'in_review>rejected')"))
def mut10_transition_fold(spark, sf_dir):
    """Status events folded through the state machine, accepted or turned away."""
    t = F.col("event_type")
    target = F.when(t == "signup", "in_progress").when(t == "click", "done").when(t == "view", "in_review").when(t == "purchase", "approved").otherwise("rejected")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return B.fold_transitions(table(spark, sf_dir, "events").select("user_id", seq.alias("seq"), target.alias("target")), "user_id")


@query(f"SELECT parent, bool_or(assignee <> '' AND status = 'in_progress') AS advances FROM ({_TICKETS}) GROUP BY parent")
def mut11_spec_advances(spark, sf_dir):
    """Specs that a first claim moves on."""
    return _tickets(spark, sf_dir).groupBy("parent").agg(F.bool_or((F.col("assignee") != "") & (F.col("status") == "in_progress")).alias("advances"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 10:00:00') || 'Z' AS updated_at, 'in_progress' AS status, o_orderpriority AS row FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'never', 'done', 'bottom' FROM orders WHERE o_orderkey % 3 = 0")
def agg13_latest_progress(spark, sf_dir):
    """The latest row of each progress table, else its last row."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    head = F.lit("# t\n| a | b | c |\n## Progress Log\n| Timestamp (UTC) | Status | Progress |\n|---|---|---|\n")
    good = F.concat(F.lit("| "), day, F.lit(" 09:00:00Z | in_progress | old |\n| "), day, F.lit(" 10:00:00Z | in_progress | "), "o_orderpriority", F.lit(" |\n| garbage | x | y |\n## Next\n| 2099-01-01 00:00:00Z | q | q |\n"))
    poor = F.lit("| sometime | backlog | top |\n| never | done | bottom |\n")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(head, F.when(F.col("o_orderkey") % 3 == 0, poor).otherwise(good)).alias("body"))
    return B.latest_progress(rows, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing title' WHEN o_orderkey % 5 = 0 THEN 'missing parent' WHEN o_orderkey % 3 = 0 THEN 'unknown status' END AS error FROM orders")
def dt12_validate(spark, sf_dir):
    """Board rows with collected errors."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("x").alias("id"), F.when(k % 7 != 0, "t").alias("title"), F.lit("o").alias("owner"), F.lit("T").alias("layer"), F.when(k % 5 != 0, "G1.S1").alias("parent"), F.when(k % 3 == 0, "odd").otherwise("done").alias("status"))
    return B.validate(rows).select("o_orderkey", "error")


@query("SELECT ref, list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'no title ' || ref END, CASE WHEN o_orderkey % 6 = 0 THEN 'no criteria ' || ref END], lambda x: x IS NOT NULL) AS problems FROM (SELECT o_orderkey, 'G1.S2.T' || o_orderkey AS ref FROM orders) WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0")
def dt11_plan_problems(spark, sf_dir):
    """Problems of a plan's tickets."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("G1.S2.T"), k).alias("ref"), F.lit("G1.S2").alias("parent"), F.when(k % 4 != 0, "t").alias("title"), F.when(k % 6 != 0, F.array(F.lit("c"))).alias("acceptance_criteria"))
    return B.plan_problems(rows)


@query("SELECT l_orderkey, 'Parts:' || chr(10) || string_agg(CASE WHEN l_linestatus = 'F' THEN '- [x] ' ELSE '- [ ] ' END || 'T' || l_linenumber, chr(10) ORDER BY l_linenumber, l_linestatus DESC) AS body FROM lineitem GROUP BY l_orderkey")
def txt30_issue_body(spark, sf_dir):
    """A check list of the parts of each order."""
    line = F.concat(F.when(F.col("l_linestatus") == "F", "- [x] ").otherwise("- [ ] "), F.lit("T"), "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("lines"))
    return rows.select("l_orderkey", F.concat(F.lit("Parts:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("body"))


@query("""SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'click' AND e.event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)""")
def jn14_unseen(spark, sf_dir):
    """Comments that nobody has seen yet."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").select("event_id", "user_id")


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 THEN list_sort(list(o_orderkey)) ELSE [-c_custkey] END AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jn13_sub_issues(spark, sf_dir):
    """Children by link, else by title prefix."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    linked = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("linked"))
    named = c.select("c_custkey", F.array(-F.col("c_custkey")).alias("named"))
    return c.select("c_custkey").join(linked, "c_custkey", "left").join(named, "c_custkey").select("c_custkey", F.coalesce("linked", "named").alias("children"))


@query("SELECT o_orderkey, list_sort(list(p)) AS deps FROM (SELECT o_orderkey, unnest([l1, l2]) AS p FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l1, CAST(NULL AS BIGINT) AS l2 FROM orders)) WHERE p IS NOT NULL GROUP BY o_orderkey")
def jn17_dependencies(spark, sf_dir):
    """Blockers as ids; references to nothing are dropped."""
    t = _tickets(spark, sf_dir)
    ids = t.select(F.col("ref").alias("blocker"), F.col("o_orderkey").alias("dep"))
    return t.select("o_orderkey", F.explode("blocked_by").alias("blocker")).join(ids, "blocker").groupBy("o_orderkey").agg(F.array_sort(F.collect_list("dep")).alias("deps"))
