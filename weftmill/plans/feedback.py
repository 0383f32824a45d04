"""Queries over feedback: a quarter of the vectors are stored questions, the others ask in order of id."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.operators import feedback as B
from weftmill.plans.registry import query, table

_T = 0.4
_GREEDY = f"""WITH RECURSIVE v AS (SELECT vec_id AS n, CAST(embedding AS DOUBLE[]) AS e, coalesce(label, 0) AS label FROM embeddings),
g AS (SELECT a.n, b.n AS m, b.n % 4 = 0 AS stored, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.n % 4 <> 0 AND (b.n % 4 = 0 OR b.n < a.n)),
h AS (SELECT * FROM g WHERE score >= {_T}),
s AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM v WHERE n % 4 <> 0),
b AS (SELECT s.i, s.n, coalesce(bool_or(h.stored), false) AS old, list(h.m) FILTER (NOT h.stored) AS near FROM s LEFT JOIN h USING (n) GROUP BY s.i, s.n),
r(i, made) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT b.i, CASE WHEN b.old OR list_has_any(r.made, coalesce(b.near, [])) THEN r.made ELSE list_append(r.made, b.n) END FROM r JOIN b ON b.i = r.i + 1),
c AS (SELECT unnest(made) AS m FROM r WHERE i = (SELECT max(i) FROM s)),
k AS (SELECT n, CASE WHEN stored THEN m ELSE -m - 1 END AS id, score FROM h WHERE stored OR m IN (SELECT m FROM c)),
x AS (SELECT n, id, score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS p FROM k) WHERE p = 1),
y AS (SELECT s.n, coalesce(x.id, -s.n - 1) AS id, x.score, x.n IS NULL AS made FROM s LEFT JOIN x USING (n))"""


def _inputs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce("label", F.lit(0)).alias("label"))
    question, answer = F.concat(F.lit("q"), "vec_id"), F.concat(F.lit("a"), F.col("label") % 3)
    sources, feedback = F.array(F.concat(F.lit("wiki/"), F.col("label") % 4)), F.when(F.col("label") % 2 == 0, "up").otherwise("down")
    row = v.select("vec_id", question.alias("question"), "vector", answer.alias("answer"), sources.alias("sources"), feedback.alias("feedback"))
    return row.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "id"), row.where("vec_id % 4 <> 0").withColumnRenamed("vec_id", "n")


@query(f"{_GREEDY} SELECT n, id, score, made FROM y")
def mut6_feedback_matches(spark, sf_dir):
    """The pair that each feedback lands on, its own if nothing similar came before."""
    return B.assign(*_inputs(spark, sf_dir), _T)


@query(f"""{_GREEDY}, f AS (SELECT y.id, y.n, label, CASE WHEN label % 2 = 0 THEN 'up' ELSE 'down' END AS d FROM y JOIN v USING (n)),
o AS (SELECT n AS id, CASE WHEN label % 2 = 0 THEN 'up' ELSE 'down' END AS d FROM v WHERE n % 4 = 0),
w AS (SELECT f.*, coalesce(lag(f.d) OVER (PARTITION BY f.id ORDER BY f.n), o.d) AS before FROM f LEFT JOIN o ON o.id = f.id)
SELECT 'wiki/' || label % 4 AS path, d AS feedback, count(*) AS moves FROM w WHERE before IS DISTINCT FROM d GROUP BY ALL""")
def mut6_confidence_moves(spark, sf_dir):
    """How often each direction moves a page's confidence."""
    return B.record(*_inputs(spark, sf_dir), _T)[2]


@query(f"""{_GREEDY}, a AS (SELECT id, n, label FROM (SELECT y.id, y.n, label FROM y JOIN v USING (n) UNION ALL SELECT n, -1, label FROM v WHERE n % 4 = 0)),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS p, 'a' || label % 3 AS answer, min(n) OVER (PARTITION BY id, label % 4) = n AS fresh, first_value('a' || label % 3) OVER (PARTITION BY id ORDER BY n) AS head FROM a),
u AS (SELECT *, coalesce(max(CAST(answer <> head AS INTEGER)) OVER (PARTITION BY id ORDER BY p), 0) AS apart FROM t)
SELECT id, string_agg(answer, chr(10) || chr(10) ORDER BY p) FILTER (p = 1 OR apart = 1) AS answer, list('wiki/' || label % 4 ORDER BY p) FILTER (fresh) AS sources, arg_max(CASE WHEN label % 2 = 0 THEN 'up' ELSE 'down' END, p) AS feedback FROM u GROUP BY id""")
def mut5_merged_pairs(spark, sf_dir):
    """All pairs after the feedback: answers appended, sources joined, the latest feedback."""
    return B.record(*_inputs(spark, sf_dir), _T)[0].select("id", "answer", "sources", "feedback")


@query(f"""{_GREEDY.replace("CASE WHEN b.old OR list_has_any(r.made, coalesce(b.near, [])) THEN r.made ELSE list_append(r.made, b.n) END", "CASE WHEN (b.old OR list_has_any(r.made, coalesce(b.near, []))) AND b.n % 5 <> 2 THEN r.made ELSE list_append(r.made, b.n) END")}
SELECT n, CASE WHEN score IS NOT NULL THEN id END AS id, score, CASE WHEN score IS NULL THEN 'inserted' WHEN n % 5 = 0 THEN 'merged' WHEN n % 5 = 1 THEN 'overwritten' WHEN n % 5 = 2 THEN 'added_anyway' ELSE 'needs_decision' END AS action FROM y""")
def mut7_manual_outcomes(spark, sf_dir):
    """What each manual addition does, by the pair it is similar to and its mode."""
    pairs, inputs = _inputs(spark, sf_dir)
    k = F.col("n") % 5
    return B.manual_add(pairs, inputs.withColumn("mode", F.when(k == 0, "merge").when(k == 1, "overwrite").when(k == 2, "add-anyway")), _T)[1]
