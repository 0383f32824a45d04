"""Queries over retrieval operators. Benchmark items are the queries; item i asks with vector i (a fixture convention)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftmill.operators import retrieval as S
from weftmill.plans.registry import TOKENS, query, table

_K = 20


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi").select(F.col("id").alias("qid"), "vector")


_VECTOR = f"""SELECT qid, id, score, rn - 1 AS rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM (
SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings c ON true WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rn <= {_K}"""
_BM25 = f"""WITH d AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id AS qid, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY qid, id)
SELECT qid, id, score, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM w) WHERE rn <= {_K}"""
# entities: two longer words of each item, related in a ring
_ENTITY = """SELECT item_id, t[1] AS entity, [t[2]] AS aliases FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) >= 7) AS t FROM benchmark) WHERE len(t) >= 2"""
_MENTION = f"""SELECT DISTINCT e.entity, d.doc_id AS id FROM ({_ENTITY}) e JOIN documents d ON contains(lower(d.text), e.entity) OR contains(lower(d.text), e.aliases[1])"""
_RELATION = f"""SELECT a.entity AS source, b.entity AS target FROM (SELECT entity, row_number() OVER (ORDER BY item_id) AS i FROM ({_ENTITY})) a JOIN (SELECT entity, row_number() OVER (ORDER BY item_id) AS i FROM ({_ENTITY})) b ON b.i = a.i + 1"""
_NEAR = f"SELECT entity, list_sort(list(DISTINCT neighbour)) AS neighbours FROM (SELECT source AS entity, target AS neighbour FROM ({_RELATION}) UNION ALL SELECT target, source FROM ({_RELATION})) WHERE entity <> neighbour GROUP BY entity"
_GRAPH = f"""SELECT qid, id, score, rank, entity, neighbours FROM (SELECT qid, id, score, entity, coalesce(neighbours, []) AS neighbours, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id, entity) - 1 AS rank
FROM (SELECT b.item_id AS qid, e.entity, CAST(1 + len(e.entity) / 100.0::DOUBLE AS DOUBLE) AS score FROM benchmark b JOIN (SELECT DISTINCT entity FROM ({_ENTITY})) e ON contains(lower(b.text), e.entity)) m JOIN ({_MENTION}) USING (entity) LEFT JOIN ({_NEAR}) USING (entity)) WHERE rank < {_K}"""


def _fused(*lists: str) -> str:
    every = " UNION ALL ".join(f"SELECT qid, id, score, rank, {i} AS source FROM ({x})" for i, x in enumerate(lists))
    return f"""SELECT qid, id, fused, score, source, rank FROM (SELECT qid, id, fused, f.score, f.source, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, f.source, f.rank, id) - 1 AS rank FROM (
SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS fused, arg_min({{'score': score, 'source': source, 'rank': rank}}, source * 100000 + rank) AS f FROM ({every}) GROUP BY qid, id)) WHERE rank < 10"""


def _entities(spark, sf_dir):
    t = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 7)
    rows = table(spark, sf_dir, "benchmark").select("item_id", t.alias("t")).where(F.size("t") >= 2)
    return rows.select("item_id", F.col("t")[0].alias("entity"), F.array(F.col("t")[1]).alias("aliases"))


def _relations(spark, sf_dir):
    w = Window.orderBy("item_id")  # the curated entity list, a few rows
    return _entities(spark, sf_dir).select(F.col("entity").alias("source"), F.lead("entity").over(w).alias("target")).where("target is not null")


def _mentions(spark, sf_dir):
    e = _entities(spark, sf_dir).groupBy("entity").agg(F.flatten(F.collect_list("aliases")).alias("aliases"))
    return S.mentions(_corpus(spark, sf_dir), e)


def _vector(spark, sf_dir):
    return S.vector_topk(_asked(spark, sf_dir), _vectors(spark, sf_dir), _K)


def _bm25(spark, sf_dir):
    return S.bm25(_questions(spark, sf_dir), _corpus(spark, sf_dir), _K)


def _graph(spark, sf_dir):
    e = _entities(spark, sf_dir).select("entity").distinct()
    asked = S.mentions(_questions(spark, sf_dir).withColumnRenamed("qid", "id"), e.withColumn("aliases", F.array().cast("array<string>"))).withColumnRenamed("id", "qid")
    return S.graph_topk(asked.withColumn("score", 1 + F.length("entity") / 100.0), _mentions(spark, sf_dir), _relations(spark, sf_dir), _K)


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def ret2_cosine(spark, sf_dir):
    """Cosine of neighbouring vectors."""
    a, b = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query(_VECTOR)
def ret1_vector_topk(spark, sf_dir):
    """Exact vector search."""
    return _vector(spark, sf_dir)


@query(_VECTOR.replace("FROM benchmark)", "FROM benchmark) AND c.label IN (1, 3)"))
def flt4_filtered_vector_topk(spark, sf_dir):
    """Vector search within two labels: the filter comes before the ranking."""
    return S.vector_topk(_asked(spark, sf_dir), _vectors(spark, sf_dir).where(F.col("label").isin(1, 3)), _K)


@query(_BM25)
def ret3_bm25(spark, sf_dir):
    """Text search."""
    return _bm25(spark, sf_dir)


@query(_MENTION)
def jn4_mentions(spark, sf_dir):
    """Documents that mention an entity or its alias."""
    return _mentions(spark, sf_dir)


@query(_GRAPH)
def ret4_graph_topk(spark, sf_dir):
    """Documents by matched entities, with neighbours."""
    return _graph(spark, sf_dir).select("qid", "id", "score", "rank", "entity", "neighbours")


@query(_fused(_VECTOR, _BM25))
def ret6_hybrid(spark, sf_dir):
    """Vector and text search, fused."""
    return S.rrf([_vector(spark, sf_dir), _bm25(spark, sf_dir)], 10)


@query(_fused(_VECTOR, _BM25, f"SELECT qid, id, score, rank FROM ({_GRAPH})"))
def hybrid_search(spark, sf_dir):
    """Three sources fused: vectors, text, graph (a document named by several entities adds up)."""
    return S.rrf([_vector(spark, sf_dir), _bm25(spark, sf_dir), _graph(spark, sf_dir)], 10)


@query(f"""WITH h AS ({_BM25}), s AS (SELECT h.qid, h.id, h.rank AS before, round(len(list_intersect(q.t, d.t)) / greatest(1, len(q.t))::DOUBLE, 6) AS score FROM h JOIN (SELECT item_id AS qid, list_distinct({TOKENS}) AS t FROM benchmark) q USING (qid) JOIN (SELECT doc_id AS id, list_distinct({TOKENS}) AS t FROM documents) d USING (id) WHERE h.rank < 10)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) - 1 AS rank FROM s""")
def ret9_rerank(spark, sf_dir):
    """The ten best text hits in the order of their word overlap."""
    return S.rerank(_bm25(spark, sf_dir), _corpus(spark, sf_dir), _questions(spark, sf_dir), 10)


@query(f"""WITH h AS ({_BM25}), n AS (SELECT h.qid, h.id, c.doc_id AS other, row_number() OVER (PARTITION BY h.qid, h.id ORDER BY c.doc_id) AS i FROM h JOIN documents d ON d.doc_id = h.id JOIN documents c ON c.source = d.source AND c.lang = d.lang AND c.doc_id <> d.doc_id)
SELECT h.qid, h.id, coalesce((SELECT list(other ORDER BY other) FROM n WHERE n.qid = h.qid AND n.id = h.id AND i <= 4), []) AS siblings FROM h""")
def ret10_siblings(spark, sf_dir):
    """Hits with up to four others of their section."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("section"))
    return S.siblings(_bm25(spark, sf_dir), chunks).select("qid", "id", "siblings")


@query("""WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark))
SELECT qid, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM s) WHERE rn = 1 AND score >= 0.3""")
def ret12_similar_question(spark, sf_dir):
    """The most similar other vector of each question, if similar enough."""
    return S.best_match(_asked(spark, sf_dir), _vectors(spark, sf_dir), 0.3)


@query("SELECT doc_id FROM documents WHERE lang || '/' || source = 'en/src1' OR starts_with(lang || '/' || source, 'en/src1/') OR lang = 'de'")
def flt2_scope(spark, sf_dir):
    """Documents whose topic is at or below a scope."""
    topic = F.concat_ws("/", "lang", "source")
    return table(spark, sf_dir, "documents").where(S.in_scope(topic, "en/src1") | S.in_scope(topic, "de")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def flt1_topics(spark, sf_dir):
    """Documents of a topic list; an empty list filters nothing."""
    from weftmill.operators.graph import topic_filter

    return table(spark, sf_dir, "documents").where(topic_filter(F.col("source"), topic="src9", topics=["src1", "src2"])).select("doc_id")


@query("SELECT item_id, contains(lower(text), 'the') OR contains(lower(text), 'que') AS hit FROM benchmark")
def flt6_contains(spark, sf_dir):
    """Case-insensitive contains over several fields."""
    q = table(spark, sf_dir, "benchmark")
    return q.select("item_id", F.exists(F.array("text", F.upper("text")), lambda x: F.lower(x).contains("the") | F.lower(x).contains("que")).alias("hit"))


@query("""WITH e AS (SELECT o_custkey AS source, -o_orderkey AS target FROM orders), b AS (SELECT source, target FROM e UNION SELECT target, source FROM e), r AS (SELECT DISTINCT x.o_custkey AS root FROM orders x WHERE x.o_orderkey <= 100 UNION SELECT -o_orderkey FROM orders WHERE o_orderkey <= 100),
n1 AS (SELECT DISTINCT root, target AS node FROM r JOIN b ON b.source = r.root), n2 AS (SELECT DISTINCT root, b.target AS node FROM n1 JOIN b ON b.source = n1.node),
a AS (SELECT root, root AS node, 0 AS depth FROM r UNION ALL SELECT root, node, 1 FROM n1 UNION ALL SELECT root, node, 2 FROM n2) SELECT root, node, min(depth) AS depth FROM a GROUP BY root, node""")
def ret14_two_hops(spark, sf_dir):
    """Everything within two undirected hops over all edges of customers and (negative) orders.

    The query set is the first orders and their customers.
    """
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (-F.col("o_orderkey")).alias("target"))
    asked = e.where("target >= -100")
    return S.hop(e, asked.select(F.explode(F.array("source", "target")).alias("root")).distinct(), 2)


@query(f"SELECT qid, count(*) AS n, string_agg('- d' || id || ': ' || score, chr(10) ORDER BY rank) AS answer FROM (SELECT qid, id, rank, CAST(CAST(floor(score * 100) AS BIGINT) AS VARCHAR) AS score FROM ({_BM25}) WHERE rank < 3) GROUP BY qid")
def ret18_plain_answer(spark, sf_dir):
    """Hits as a plain answer."""
    rows = _bm25(spark, sf_dir).where("rank < 3").withColumn("line", F.concat(F.lit("- d"), "id", F.lit(": "), F.floor(F.col("score") * 100).cast("string")))
    return rows.groupBy("qid").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("answer"))


@query(f"""WITH l AS (SELECT qid, 0 AS l, rank, id FROM ({_BM25}) UNION ALL SELECT qid, 1, rank, id FROM ({_VECTOR})), f AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY l, rank) AS c FROM l)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY l, rank) - 1 AS position FROM f WHERE c = 1""")
def set1_ordered_union(spark, sf_dir):
    """Distinct union of hit lists in order; the first of each key stays."""
    from weftmill.operators.mutations import ordered_union

    lists = [_bm25(spark, sf_dir).select("qid", "id", "rank"), _vector(spark, sf_dir).select("qid", "id", "rank")]
    return ordered_union(lists, "qid", "id", "rank")
