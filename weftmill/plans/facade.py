"""Queries over the search facade, sources and row programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.functions import udf as U
from weftmill.operators import search as Q
from weftmill.plans import entity
from weftmill.plans.registry import TOKENS, query, table
from weftmill.plans.retrieval import _BM25, _VECTOR, _asked, _corpus, _fused, _questions, _vectors
from weftmill.sources import files, paged


def _chunks(spark, sf_dir):
    topic = F.concat_ws("/", "lang", "source")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", topic.alias("topic"), topic.alias("section"))


@query("SELECT conv_id, turn, CAST(1 AS INTEGER) AS added, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS removed, turn % 2 = 0 AS structural FROM conversations")
def txt23_diff(spark, sf_dir):
    """Line diffs of two versions of each turn."""
    even = F.col("turn") % 2 == 0
    before = F.when(even, F.concat(F.lit("a\n# "), "role", F.lit("\nz"))).otherwise(F.concat(F.lit("a\nold\nolder\nz")))
    after = F.when(even, F.lit("a\n# new\nz")).otherwise(F.lit("a\nnew\nz"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", U.diff(before, after).alias("d")).select("conv_id", "turn", "d.added", "d.removed", "d.structural")


@query("SELECT o_orderkey, 'find (Plan OR Budget) for X9 in ' || o_orderpriority AS expanded FROM orders")
def txt24_expand(spark, sf_dir):
    """Terms of queries replaced by their canonicals."""
    maps = spark.createDataFrame([("forward look", ["Plan", "Budget"]), ("xnine", ["X9"])], "term string, canonicals array<string>")
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("find Forward-Look for x nine in "), "o_orderpriority").alias("query"))
    return U.expand_terms(q, maps).select("o_orderkey", "expanded")


@query("SELECT s_suppkey, 'S' || s_suppkey AS title, CAST(s_nationkey AS BIGINT) AS pr, ['a', 'n' || s_nationkey] AS blocked_by FROM supplier")
def txt6_board_frontmatter(spark, sf_dir):
    """Board front matter: quotes, integers, inline and block lists."""
    text = F.concat(F.lit('---\ntitle: "S'), "s_suppkey", F.lit('"\npr: '), "s_nationkey", F.lit("\nblocked_by:\n  - a\n  - n"), "s_nationkey", F.lit("\n---\nbody"))
    m = F.from_json(U.parse_board(text)["frontmatter"], "title string, pr long, blocked_by array<string>")
    return table(spark, sf_dir, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", "m.*")


@query("SELECT o_orderkey, 'b' || chr(10) || chr(10) || '## Log' || chr(10) || chr(10) || '- ' || o_orderstatus || chr(10) AS body FROM orders")
def txt29_log(spark, sf_dir):
    """A log section opened."""
    return table(spark, sf_dir, "orders").select("o_orderkey", U.append_log(F.lit("b\n\n"), F.col("o_orderstatus")).alias("body"))


_ENGLISH = _BM25.replace("FROM documents)", "FROM documents WHERE lang = 'en')", 1)


@query(f"WITH b AS ({_ENGLISH}) SELECT qid, id, rank FROM b WHERE rank < 5")
def ret11_scoped_search(spark, sf_dir):
    """Text search within a scope, through the facade."""
    hits = Q.search(_questions(spark, sf_dir), Q.Corpus(_chunks(spark, sf_dir)), 5, scope="en", how="bm25")
    return hits.select("qid", "id", "rank")


_TOP5 = [x.replace("rn <= 20", "rn <= 5") for x in (_VECTOR, _BM25)]
_FUSED5 = _fused(_TOP5[0], *(f"SELECT * FROM ({x}) WHERE qid IN (SELECT vec_id FROM embeddings)" for x in (_TOP5[1], f"SELECT qid, id, score, rank FROM ({entity.search_sql(5, 5)})"))).replace("WHERE rank < 10", "WHERE rank < 5")


@query(f"""WITH h AS ({_FUSED5}), n AS (SELECT h.qid, h.id, c.doc_id AS other, row_number() OVER (PARTITION BY h.qid, h.id ORDER BY c.doc_id) AS i FROM h JOIN documents d ON d.doc_id = h.id JOIN documents c ON c.source = d.source AND c.lang = d.lang AND c.doc_id <> d.doc_id)
SELECT h.qid, h.id, h.fused, h.source, h.rank, coalesce((SELECT list(other ORDER BY other) FROM n WHERE n.qid = h.qid AND n.id = h.id AND i <= 4), []) AS siblings FROM h JOIN documents ON doc_id = h.id""")
def ret7_fused_search(spark, sf_dir):
    """Vectors, text and graph fused, with siblings, through the facade."""
    asked = _questions(spark, sf_dir).join(_asked(spark, sf_dir), "qid")
    e = entity._entities(spark, sf_dir)
    relations = e.select(F.col("entity").alias("source"), F.explode("aliases").alias("target"))
    corpus = Q.Corpus(_chunks(spark, sf_dir), _vectors(spark, sf_dir), e, relations)
    return Q.search(asked, corpus, 5, enrich=True).select("qid", "id", "fused", "source", "rank", "siblings")


_KEYWORD = _BM25.replace("FROM documents)", "FROM (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0))", 1).replace("rn <= 20", "rn <= 5")
_SCOPED = _BM25.replace("FROM documents)", "FROM documents WHERE lang = 'en')", 1).replace("rn <= 20", "rn <= 5")


@query(f"""WITH s AS (SELECT qid, 0 AS kind, id, round(1.0::DOUBLE / (61 + rank), 9) AS score, rank FROM ({_SCOPED})), k AS (SELECT qid, 1 AS kind, id, score, rank FROM ({_KEYWORD}) WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
h AS (SELECT * FROM s UNION ALL SELECT * FROM k)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY kind, rank, id) - 1 AS position, CASE kind WHEN 0 THEN 'semantic' ELSE 'keyword' END AS kind, id, CASE WHEN id % 2 = 0 THEN 'wiki/' || id || '.md' END AS path, score FROM h""")
def ret11_knowledge_search(spark, sf_dir):
    """Semantic hits and keyword hits of wiki pages (every other document) within a scope."""
    chunks = _chunks(spark, sf_dir)
    pages = chunks.where("id % 2 = 0").select("id", "text", "topic", F.concat(F.lit("wiki/"), "id", F.lit(".md")).alias("path"))
    return Q.knowledge_search(_questions(spark, sf_dir), lambda: Q.Corpus(chunks), lambda: pages, scope="en", how="bm25").results


_DEFINITION = " OR ".join(f"regexp_matches(t, '{x}')" for x in (r"^(what|who|which|where|when|whose|how)\s+(is|are|was|were|does|do|did)\s+", r"^(what|who|which|where|when)\s+.*\b(is|are|was|were)\b", r"^define\s+", r"^what\s+does\s+\S+\s+mean", r"\bis\s+[a-z0-9_-]+\s*[?.]?$"))
_PARTS = rf"""(WITH pl AS (SELECT item_id AS qid, text, regexp_replace(lower(trim(text)), '[?!.]+$', '') AS t FROM benchmark),
k AS (SELECT qid, text, CASE WHEN {_DEFINITION} THEN 'direct' WHEN len(string_split_regex(trim(text), '\s+')) < 2 THEN 'clarify' WHEN contains(text, ' and ') THEN 'decompose' ELSE 'direct' END AS plan FROM pl)
SELECT qid, plan, text, CASE WHEN plan = 'decompose' THEN string_split(text, ' and ') WHEN plan = 'direct' THEN [text] ELSE [] END AS parts FROM k)"""
_PLANNED = _BM25.replace("FROM benchmark)", f"FROM (SELECT qid * 1000 + generate_subscripts(parts, 1) - 1 AS item_id, unnest(parts) AS text FROM {_PARTS}))", 1).replace("rn <= 20", "rn <= 5")


@query(f"""WITH h AS ({_PLANNED}), f AS (SELECT qid // 1000 AS qid, id, min((qid % 1000) * 1000 + rank) AS seen FROM h GROUP BY 1, 2), l AS (SELECT qid, list(id ORDER BY seen, id)[1:5] AS hits FROM f GROUP BY qid)
SELECT p.qid, p.plan, coalesce(l.hits, []) AS hits FROM {_PARTS} p LEFT JOIN l USING (qid)""")
def ret17_planned_answers(spark, sf_dir):
    """Planned answers to a batch of questions."""
    return Q.Planner().answer(_questions(spark, sf_dir), Q.Corpus(_chunks(spark, sf_dir)), 5)


@query("SELECT page_id, 0 AS position, 'T ' || page_id || ' & co' AS title, 'https://e.org/' || page_id AS url, 's' AS snippet FROM pages")
def src14_search_results(spark, sf_dir):
    """Results of search-result pages."""
    html = F.concat(F.lit('x<a class="result__a" href="//d/l/?uddg=https%3A%2F%2Fe.org%2F'), "page_id", F.lit('&r=1">T <b>'), "page_id", F.lit('</b> &amp; co</a><a class="result__snippet"> s </a>'))
    return files.search_results(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


@query("SELECT CAST(page AS INTEGER) AS page, count(*) AS n FROM (SELECT range // 100 + 1 AS page FROM range(230)) GROUP BY page")
def src10_paged(spark, sf_dir):
    """A paged collection, one partition a page."""
    paged.register(spark)
    table(spark, sf_dir, "region")  # ships the package
    rows = spark.read.format("paged").options(fetch="weftmill.sources.paged:sample_fetch", resource="issues", pages=4).load()
    return rows.groupBy("page").agg(F.count("*").alias("n"))


@query(f"SELECT path, count(*) AS read_count FROM (SELECT DISTINCT qid, path FROM (SELECT qid, 'wiki/' || source AS path FROM ({_BM25}) JOIN documents ON doc_id = id)) GROUP BY path")
def mut8_search_reads(spark, sf_dir):
    """Read events of a search, each page once a query."""
    from weftmill.operators.retrieval import bm25

    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("wiki/"), "source").alias("path"))
    return Q.read_counts(Q.reads(bm25(_questions(spark, sf_dir), _corpus(spark, sf_dir), 20), pages))


@query(f"SELECT id, count(*) AS n FROM (SELECT doc_id AS id, unnest(list_distinct({TOKENS})) AS term FROM documents) WHERE term IN (SELECT unnest({TOKENS}) FROM benchmark) GROUP BY id")
def ret3_postings(spark, sf_dir):
    """Distinct query terms of each document, from the postings."""
    from weftmill.functions.text import tokens
    from weftmill.operators.retrieval import postings

    terms = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return postings(_corpus(spark, sf_dir)).join(terms, "term", "left_semi").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS source, 's' || l_suppkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN ['a', 'b'] ELSE [] END AS keywords FROM lineitem")
def txt27_coercion(spark, sf_dir):
    """Relations out of loose JSON: either spelling of the ends, missing lists empty."""
    from weftmill.functions.text import relation_of

    k = F.col("l_linenumber") % 2 == 0
    a, b = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    loose = F.when(k, F.concat(F.lit('{"source": "'), a, F.lit('", "target": "'), b, F.lit('", "keywords": ["a", "b"]}'))).otherwise(F.concat(F.lit('noise {"from": " '), a, F.lit('", "to": "'), b, F.lit('"} noise')))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", relation_of(loose).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("""WITH old AS (SELECT l_orderkey AS doc, l_linenumber AS id, min(l_partkey) AS h FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL), new AS (SELECT l_orderkey AS doc, l_linenumber AS id, max(l_partkey) AS h FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL)
SELECT coalesce(o.doc, n.doc) AS doc, coalesce(o.id, n.id) AS id, n.h, n.h IS DISTINCT FROM o.h AS embed_again FROM old o FULL JOIN new n ON o.doc = n.doc AND o.id = n.id WHERE n.id IS NOT NULL""")
def mut3_overwrite(spark, sf_dir):
    """A document overwritten: stale chunks go, only changed or new ones are embedded again."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), "l_partkey")
    old = line.where("id <> 2").groupBy("doc", "id").agg(F.min("l_partkey").alias("was"))
    new = line.where("id <> 3").groupBy("doc", "id").agg(F.max("l_partkey").alias("h"))
    return new.join(old, ["doc", "id"], "left").select("doc", "id", "h", (~F.col("h").eqNullSafe(F.col("was"))).alias("embed_again"))


_LINES = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: i || ' ' || x)"


@query(f"""WITH t AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, {_LINES} AS l FROM documents)),
k AS (SELECT *, i % 7 = 3 AS gone, i % 7 <> 3 AND i % 5 = 2 AS new FROM t),
m AS (SELECT *, gone OR new AS hit, CAST(sum(CAST(NOT gone AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - CAST(NOT gone AS INTEGER) AS before, i - row_number() OVER (PARTITION BY doc_id, gone OR new ORDER BY i) AS run FROM k),
h AS (SELECT doc_id, min(i) AS i, '@@ -' || min(i) || ',' || count(*) || ' +' || (min(before) + 1) || ',' || count(*) FILTER (new) || ' @@' || string_agg(chr(10) || '-' || line, '' ORDER BY i)
        || coalesce(string_agg(chr(10) || '+' || line || ' (edited)', '' ORDER BY i) FILTER (new), '') AS part FROM m WHERE hit GROUP BY doc_id, run),
u AS (SELECT doc_id, count(*) AS hunks, string_agg(part, chr(10) ORDER BY i) AS unified FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(u.hunks, 0) AS hunks, coalesce(u.unified, '') AS unified FROM documents d LEFT JOIN u USING (doc_id)""")
def txt23_hunks(spark, sf_dir):
    """Hunks between each text, its lines numbered, and a version with every seventh line gone and every fifth edited."""
    from weftmill.functions.hunks import diff_hunks

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))
    edited = F.transform(lines, lambda x, i: F.when((i + 1) % 7 == 3, None).when((i + 1) % 5 == 2, F.concat(x, F.lit(" (edited)"))).otherwise(x))
    d = diff_hunks(F.array_join(lines, "\n"), F.array_join(edited, "\n"))  # null elements are left out
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("d")).select("doc_id", F.size("d.hunks").cast("long").alias("hunks"), "d.unified")


@query("""SELECT o_orderkey, '---' || chr(10) || 'title: ' || CASE WHEN regexp_full_match(o_orderpriority, '[A-Za-z0-9_./-]+') THEN o_orderpriority ELSE '"' || o_orderpriority || '"' END || chr(10) || 'pr: ' || o_custkey || chr(10)
  || CASE WHEN o_orderkey % 2 = 0 THEN 'blocked_by: []' ELSE 'blocked_by:' || chr(10) || '  - "o' || o_custkey || '"' || chr(10) || '  - "' || o_orderstatus || ' x"' END || chr(10) || '---' || chr(10) || chr(10) || o_orderstatus || chr(10) AS file FROM orders""")
def snk6_board_files(spark, sf_dir):
    """Board files of tickets: texts quoted if need be, lists as quoted block lists."""
    from weftmill.functions.boards import board_file

    blocked = F.when(F.col("o_orderkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("o"), "o_custkey"), F.concat("o_orderstatus", F.lit(" x"))))
    fields = {"title": (F.col("o_orderpriority"), "string"), "pr": (F.col("o_custkey"), "long"), "blocked_by": (blocked, "array<string>")}
    return table(spark, sf_dir, "orders").select("o_orderkey", board_file(fields, F.col("o_orderstatus")).alias("file"))


@query("""SELECT p_partkey, '---' || chr(10) || 'title: ' || p_name || chr(10) || 'read_count: ' || (p_partkey % 9) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'updated: 2024-05-05' || chr(10) || 'topic: ' || p_brand ELSE 'topic: ' || p_brand || chr(10) || 'updated: 2024-05-05' END
  || chr(10) || '---' || chr(10) || p_type AS page FROM part""")
def txt7_patched_pages(spark, sf_dir):
    """Pages whose front matter is patched: keys in place or at the end, the body kept."""
    from weftmill.functions.boards import patched

    page = F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nread_count: 0\n"), F.when(F.col("p_partkey") % 2 == 0, "updated: 2000-01-01\n").otherwise(""), F.lit("---\n"), "p_type")
    changes = {"read_count": (F.col("p_partkey") % 9).cast("string"), "topic": F.col("p_brand")}
    return table(spark, sf_dir, "part").select("p_partkey", patched(page, changes, F.lit("2024-05-05")).alias("page"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'b' || chr(10) || chr(10) || '## Progress Log' || chr(10) || chr(10) || '| UTC timestamp | status | progress |' || chr(10) || '|---|---|---|' || chr(10) || '| t | ' || o_orderstatus || ' | ' || o_custkey || ' |' || chr(10) || '| old | x | y |' || chr(10)
  ELSE o_orderpriority || chr(10) || chr(10) || '## Progress Log' || chr(10) || chr(10) || '| UTC timestamp | status | progress |' || chr(10) || '|---|---|---|' || chr(10) || '| t | ' || o_orderstatus || ' | ' || o_custkey || ' |' || chr(10) END AS body FROM orders""")
def txt29_progress(spark, sf_dir):
    """Progress rows put first in their table, which is made where there is none."""
    head = "b\n\n## Progress Log\n\n| UTC timestamp | status | progress |\n|---|---|---|\n| old | x | y |\n"
    body = F.when(F.col("o_orderkey") % 2 == 0, head).otherwise(F.concat("o_orderpriority", F.lit("\n")))
    row = F.concat(F.lit("| t | "), "o_orderstatus", F.lit(" | "), "o_custkey", F.lit(" |"))
    return table(spark, sf_dir, "orders").select("o_orderkey", U.insert_progress(body, row).alias("body"))
