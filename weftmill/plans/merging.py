"""Queries over merged sections, deleted pages, retried stages and superseded connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.operators import pages as P
from weftmill.operators import refine as R
from weftmill.operators import stages as G
from weftmill.plans.registry import query, table

# a hundred documents of a source are the sections of one, their lines are its chunks
_DOC = "source || '/' || doc_id // 100"


def _chunks(spark, sf_dir):
    doc = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    rows = table(spark, sf_dir, "documents").select(doc.alias("doc"), F.col("doc_id").alias("pos"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return rows.withColumn("id", F.concat(F.lit("c"), F.col("at") + 1))


@query(f"""WITH l AS (SELECT {_DOC} AS doc, doc_id AS pos, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT pos, 'c' || i AS id, 'c' || row_number() OVER (PARTITION BY doc ORDER BY pos, i) AS new_id FROM l""")
def agg6_renumbered(spark, sf_dir):
    """Chunks of sections numbered through their documents."""
    return R.renumbered(_chunks(spark, sf_dir)).select("pos", "id", "new_id")


@query(f"""WITH l AS (SELECT {_DOC} AS doc, doc_id AS pos, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS text FROM documents),
n AS (SELECT *, 'c' || row_number() OVER (PARTITION BY doc ORDER BY pos, i) AS new_id FROM l), w AS (SELECT doc, pos, i, new_id, regexp_extract(text, '[A-Za-z]+', 0) AS name FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, lower(name) ORDER BY pos, i) AS k FROM w WHERE name <> '') SELECT doc, name, new_id FROM r WHERE k = 1""")
def agg6_entities(spark, sf_dir):
    """Entities (the first word of each line) once a document in any case, with the new number of the chunk that first names them."""
    chunks = _chunks(spark, sf_dir)
    named = chunks.select("doc", "pos", "at", "id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"), F.lit("t").alias("type"), F.col("id").alias("description"))
    first = R.entities(named).withColumnRenamed("description", "id")
    return R.remapped(first, chunks).select("doc", "name", "new_id")


@query("""WITH p AS (SELECT doc_id, ['wiki', lang, source, CAST(doc_id % 97 AS VARCHAR)] AS f, doc_id % 97 < 40 OR source IN ('src3', 'src7') OR lang = 'de' AS gone FROM documents),
a AS (SELECT array_to_string(f[1 : i], '/') AS folder, gone FROM p, range(1, 5) AS r(i)) SELECT folder, count(*) AS pages FROM a GROUP BY folder HAVING bool_and(gone)""")
def snk5_emptied_folders(spark, sf_dir):
    """Folders, at any depth, that a delete of pages leaves empty."""
    path = F.concat_ws("/", F.lit("wiki"), "lang", "source", (F.col("doc_id") % 97).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    pages = table(spark, sf_dir, "documents").withColumn("path", path)
    gone = pages.where((F.col("doc_id") % 97 < 40) | F.col("source").isin("src3", "src7") | (F.col("lang") == "de"))
    return P.delete(pages, gone)[1]


_RETRY = """WITH RECURSIVE s AS (SELECT l_orderkey AS task, CASE l_linenumber % 4 WHEN 0 THEN 'parsing' WHEN 1 THEN 'refinement' WHEN 2 THEN 'ingesting_wiki' ELSE 'ingesting_graph' END AS stage,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_quantity > 48 THEN 'running' ELSE 'done' END AS status, l_linenumber AS seen FROM lineitem),
l AS (SELECT task, stage, status FROM (SELECT *, row_number() OVER (PARTITION BY task, stage ORDER BY seen DESC, status) AS n FROM s) WHERE n = 1),
g(need, stage) AS (VALUES ('parsing', 'refinement'), ('refinement', 'ingesting_wiki'), ('refinement', 'ingesting_graph')),
o(stage, place) AS (VALUES ('parsing', 0), ('refinement', 1), ('ingesting_wiki', 2), ('ingesting_graph', 3)),
c AS (SELECT task, stage FROM l WHERE status = 'failed' UNION SELECT c.task, g.stage FROM c JOIN g ON g.need = c.stage),
t AS (SELECT task, bool_or(status = 'running') AS busy, bool_or(status = 'failed') AS failed FROM l GROUP BY task),
r AS (SELECT task, list(stage ORDER BY place) AS restarted FROM c JOIN o USING (stage) GROUP BY task)
SELECT t.task, CASE WHEN busy THEN 'busy' WHEN NOT failed THEN 'nothing' ELSE 'retried' END AS outcome, CASE WHEN NOT busy AND failed THEN restarted ELSE [] END AS restarted FROM t LEFT JOIN r USING (task)"""


@query(_RETRY)
def str10_retry_stages(spark, sf_dir):
    """What a retry of each task restarts: failed stages and all that depends on them."""
    k = F.col("l_linenumber") % 4
    stage = F.when(k == 0, "parsing").when(k == 1, "refinement").when(k == 2, "ingesting_wiki").otherwise("ingesting_graph")
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_quantity") > 48, "running").otherwise("done")
    return G.retry(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), stage.alias("stage"), status.alias("status"), F.col("l_linenumber").alias("at")))


@query("""WITH f AS (SELECT user_id % 50 AS agent, ts, event_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'dispatch' END AS kind, user_id AS task FROM events),
n AS (SELECT *, sum(CAST(kind = 'register' AS INTEGER)) OVER (PARTITION BY agent ORDER BY ts, event_id) AS era FROM f),
s AS (SELECT agent, era, event_id AS connection, ts FROM n WHERE kind = 'register'),
t AS (SELECT agent, era, task, arg_min(kind, (ts, event_id)) FILTER (kind IN ('complete', 'error')) AS kind, min(ts) FILTER (kind IN ('complete', 'error')) AS at FROM n WHERE era > 0 AND kind <> 'register' GROUP BY ALL HAVING bool_or(kind = 'dispatch'))
SELECT t.task, t.agent, s.connection, CASE WHEN t.kind IS NOT NULL THEN t.kind WHEN e.ts IS NOT NULL THEN 'superseded' ELSE 'open' END AS outcome, coalesce(t.at, e.ts) AS at
FROM t JOIN s USING (agent, era) LEFT JOIN s e ON e.agent = t.agent AND e.era = t.era + 1""")
def str3_superseded_tasks(spark, sf_dir):
    """How each task ended on each connection of its agent: by itself, or because a newer connection came."""
    kind = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "complete").otherwise("dispatch")
    frames = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("agent"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), kind.alias("kind"), F.col("event_id").alias("connection"), F.when(kind != "register", F.col("user_id")).alias("task"))
    return G.superseded(frames)
