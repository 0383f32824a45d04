"""Queries over upserts, merges, feedback and change classification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftmill.operators import graph as G
from weftmill.operators import mutations as M
from weftmill.plans.registry import query, table

_OLD = "SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 5 AS BIGINT) AS reads, c_mktsegment AS topic FROM customer WHERE c_custkey % 3 <> 0"
_NEW = "SELECT c_custkey AS id, upper(c_name) AS name, 'fresh' AS topic FROM customer WHERE c_custkey % 2 = 0"


def _old(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5).alias("reads"), F.col("c_mktsegment").alias("topic"))


def _new(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit("fresh").alias("topic"))


@query(f"SELECT coalesce(b.id, a.id) AS id, coalesce(b.name, a.name) AS name, coalesce(a.reads, 0) AS reads, coalesce(b.topic, a.topic) AS topic FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.id = b.id")
def mut1_upsert(spark, sf_dir):
    """Upsert that holds on to a counter."""
    return M.upsert(_old(spark, sf_dir), _new(spark, sf_dir), ["id"], {"reads": F.lit(0).cast("long")}, ("reads",))


@query(f"SELECT * FROM ({_OLD}) UNION ALL SELECT id, name, NULL, topic FROM ({_NEW}) WHERE id NOT IN (SELECT id FROM ({_OLD}))")
def mut4_insert_missing(spark, sf_dir):
    """Insert that leaves existing rows alone."""
    new = _new(spark, sf_dir).withColumn("reads", F.lit(None).cast("long"))
    return M.insert_missing(_old(spark, sf_dir), new.unionByName(new), ["id"], ["name"])


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def mut2_last_wins(spark, sf_dir):
    """Merge by key: the last write wins."""
    return M.keep_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def set4_first_wins(spark, sf_dir):
    """Distinct by key: the first row stays."""
    return M.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderstatus")


@query(f"SELECT a.id, coalesce(CASE WHEN a.id % 10 = 0 THEN 'x' END, a.name) AS name, a.reads, a.topic FROM ({_OLD}) a")
def mut13_patch(spark, sf_dir):
    """Partial update: null changes nothing."""
    old = _old(spark, sf_dir)
    return M.patch(old, old.select("id", F.when(F.col("id") % 10 == 0, "x").alias("name"), F.lit(None).cast("string").alias("topic")), "id")


@query("SELECT count(*) AS kept_lines, count(DISTINCT l_orderkey) AS kept_orders FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def mut12_cascade_delete(spark, sf_dir):
    """Delete with its dependent rows."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.delete(table(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]).agg(F.count("*").alias("kept_lines"), F.countDistinct("l_orderkey").alias("kept_orders"))


@query("""WITH a AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def jn9_change_classes(spark, sf_dir):
    """Old and new chunks: unchanged, changed, added, removed."""
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    b = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.sha2("text", 256)).alias("hash"))
    return G.classify_change(a, b)


_PRUNE = "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), m AS (SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE l_partkey % 2 = 0 UNION SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 3 = 0)"


def _edges(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    e = line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    m = line.where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("entity")).unionByName(line.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("entity"))).distinct()
    return e, m


@query(f"{_PRUNE} SELECT src, dst FROM e WHERE src NOT IN (SELECT entity FROM m) AND dst NOT IN (SELECT entity FROM m)")
def jn10_prunable_edges(spark, sf_dir):
    """Edges neither of whose ends is mentioned."""
    return G.prunable_edges(*_edges(spark, sf_dir)).select("src", "dst")


@query(f"{_PRUNE} SELECT p_partkey AS entity FROM part WHERE p_partkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e UNION SELECT entity FROM m)")
def jn10_orphans(spark, sf_dir):
    """Entities without edges and mentions."""
    return G.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity")), *_edges(spark, sf_dir))


@query("SELECT DISTINCT n_name AS src, r_name AS dst, arg_max(s_name, s_suppkey) AS keyword FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def jn5_relations_by_name(spark, sf_dir):
    """Relations joined on folded names; one edge a pair, the last wins."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entities = n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name")))
    rel = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return G.relation_edges(rel.select(F.lower("n_name").alias("source"), F.initcap("r_name").alias("target"), F.col("s_name").alias("keyword"), F.col("s_suppkey").alias("doc"), F.lit(0).alias("pos")), entities)


@query("SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'IN_REGION', count(*) FROM (SELECT DISTINCT n_name, n_regionkey FROM nation)")
def ret13_export(spark, sf_dir):
    """Graph export: nodes by label and edges by type, counted."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes, edges = G.export({"Nation": n.select(F.col("n_name").alias("id")), "Region": r.select(F.col("r_name").alias("id"))}, {"IN_REGION": n.select(F.col("n_name").alias("src"), F.col("n_regionkey").alias("dst"))})
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")))


@query("""WITH f AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'up' ELSE 'down' END AS d FROM events),
c AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM f)
SELECT user_id, count(*) AS votes, count(*) FILTER (before IS DISTINCT FROM d) AS moves, arg_max(d, (ts, event_id)) AS feedback FROM c GROUP BY user_id""")
def mut6_feedback_moves(spark, sf_dir):
    """Feedback moves confidence only when its direction changed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = F.when(F.col("event_type").isin("click", "purchase"), "up").otherwise("down")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", d.alias("d")).withColumn("before", F.lag("d").over(w))
    return rows.groupBy("user_id").agg(F.count("*").alias("votes"), F.count_if(~F.col("before").eqNullSafe(F.col("d"))).alias("moves"), F.max_by("d", F.struct("ts", "event_id")).alias("feedback"))


@query("SELECT user_id, count(DISTINCT (CAST(ts AS DATE), event_type)) AS reads FROM events GROUP BY user_id")
def mut8_read_counts(spark, sf_dir):
    """Reads counted once for each distinct page of a search (here: day and type)."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(F.to_date("ts"), "event_type").alias("reads"))


@query("""WITH h AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS history FROM h WHERE before IS DISTINCT FROM event_type GROUP BY user_id""")
def mut9_topic_history(spark, sf_dir):
    """Topic history without consecutive repeats."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w)).where(~F.col("before").eqNullSafe(F.col("event_type")))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ">").alias("history"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 3 THEN 'match' ELSE 'none' END AS m, CASE o_custkey % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'overwrite' WHEN 2 THEN 'add-anyway' END AS mode FROM orders)
SELECT o_orderkey, CASE WHEN m = 'none' THEN 'added' WHEN mode IS NULL THEN 'needs_decision' WHEN mode = 'merge' THEN 'merged' WHEN mode = 'overwrite' THEN 'overwritten' ELSE 'added' END AS outcome FROM s""")
def mut7_manual_add(spark, sf_dir):
    """What a manual addition does, by match and mode."""
    match, k = F.col("o_orderkey") % 10 < 3, F.col("o_custkey") % 4
    mode = F.when(k == 0, "merge").when(k == 1, "overwrite").when(k == 2, "add-anyway")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(~match, "added").when(mode.isNull(), "needs_decision").when(mode == "merge", "merged").when(mode == "overwrite", "overwritten").otherwise("added").alias("outcome"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 'w' || l_partkey % 20 AS path FROM lineitem), f AS (SELECT l_orderkey, path, min(l_linenumber) AS place FROM l GROUP BY ALL)
SELECT l_orderkey, string_agg(path, ',' ORDER BY place, path) AS paths FROM f GROUP BY l_orderkey""")
def set2_merge_sources(spark, sf_dir):
    """Union of source lists, one for each identity."""
    src = F.struct(F.concat(F.lit("w"), F.col("l_partkey") % 20).alias("path"), F.lit(None).cast("string").alias("wikiPath"), F.lit("t").alias("title"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", src.alias("s")))), lambda x: F.array(x["s"])).alias("lists"))
    return rows.select("l_orderkey", F.array_join(F.transform(M.merge_sources(F.col("lists")), lambda s: s["path"]), ",").alias("paths"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, chr(10) ORDER BY o_orderpriority) AS answer FROM orders GROUP BY o_custkey")
def mut5_merge_answers(spark, sf_dir):
    """Distinct answers of a question joined."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "\n").alias("answer"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 300)")
def src2_parse_cache(spark, sf_dir):
    """Documents whose content isn't in the cache manifest yet."""
    from weftmill.operators.dedup import new_content

    d = table(spark, sf_dir, "documents")
    manifest = d.where("doc_id < 300").select(F.sha2("text", 256).alias("content_hash"))
    return new_content(d, manifest, "text").select("doc_id")


@query("""WITH s AS (SELECT source, lang, min(doc_id) AS doc_id, bool_and(quality = 1) AS complete, round(avg(quality), 6) AS confidence, bool_or(toxic = 1) AS review, list_sort(list(DISTINCT lang)) AS langs FROM documents JOIN labels USING (doc_id) GROUP BY source, lang)
SELECT source, bool_and(complete) AS complete, round(avg(confidence), 6) AS confidence, bool_or(review) AS review, list_sort(list_distinct(flatten(list(langs)))) AS langs FROM s GROUP BY source""")
def agg6_merge_sections(spark, sf_dir):
    """Section results merged: every, mean, any, union."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    s = j.groupBy("source", "lang").agg(F.bool_and(F.col("quality") == 1).alias("complete"), F.round(F.avg("quality"), 6).alias("confidence"), F.bool_or(F.col("toxic") == 1).alias("review"), F.collect_set("lang").alias("langs"))
    return s.groupBy("source").agg(F.bool_and("complete").alias("complete"), F.round(F.avg("confidence"), 6).alias("confidence"), F.bool_or("review").alias("review"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("langs")))).alias("langs"))


@query("SELECT source, arg_max(lang, (CAST(length(trim(lang)) > 0 AS INTEGER), -doc_id)) AS summary FROM documents GROUP BY source")
def agg7_section_summary(spark, sf_dir):
    """First summary that isn't empty."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("lang", F.struct((F.length(F.trim("lang")) > 0).alias("some"), (-F.col("doc_id")).alias("at"))).alias("summary"))


@query("SELECT DISTINCT lang || '/' || source AS topic FROM documents")
def agg4_topics(spark, sf_dir):
    """Distinct topics, sorted."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("topic")).distinct().orderBy("topic")


@query("SELECT p_brand AS type, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS pages FROM part GROUP BY p_brand")
def agg11_wiki_index(spark, sf_dir):
    """Page titles grouped by type."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("type")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), "; ").alias("pages"))


@query("""SELECT node, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, lang AS node FROM documents UNION ALL SELECT doc_id, lang || '/' || source FROM documents) GROUP BY node""")
def agg12_topic_tree(spark, sf_dir):
    """Documents below each node of the topic tree."""
    parts = F.split(F.concat_ws("/", "lang", "source"), "/")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("node"))
    return rows.groupBy("node").agg(F.countDistinct("doc_id").alias("n"))


@query("SELECT DISTINCT label FROM (SELECT o_orderpriority AS label FROM orders UNION SELECT o_orderstatus FROM orders UNION SELECT c_mktsegment FROM customer)")
def agg17_label_union(spark, sf_dir):
    """Labels of several tables."""
    o = table(spark, sf_dir, "orders").select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("label"))
    return o.union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 OR c_mktsegment = 'BUILDING' THEN true ELSE false END AS allowed FROM customer")
def flt11_permission(spark, sf_dir):
    """A role or a granted permission."""
    granted = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("kb:read"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") > 5000) | F.array_contains(granted, "kb:read")).alias("allowed"))


@query("SELECT o_orderkey, list_has_all([o_orderstatus, o_orderpriority], ['F']) AND list_has_any([o_orderpriority], ['1-URGENT', '2-HIGH']) AS satisfied FROM orders")
def flt12_capabilities(spark, sf_dir):
    """All of one list and any of another."""
    have = F.array("o_orderstatus", "o_orderpriority")
    need = F.array(F.lit("F"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.forall(need, lambda x: F.array_contains(have, x)) & F.arrays_overlap(F.array("o_orderpriority"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).alias("satisfied"))


@query("SELECT n_name, CASE WHEN starts_with(n_name, 'NATION_1') THEN 'one' WHEN starts_with(n_name, 'NATION') THEN 'any' ELSE 'none' END AS page FROM nation")
def prj3_longest_prefix(spark, sf_dir):
    """The page whose route is the longest prefix of a name."""
    routes = spark.createDataFrame([("NATION", "any"), ("NATION_1", "one")], "route string, page string")
    n = table(spark, sf_dir, "nation").select("n_name")
    met = n.join(F.broadcast(routes), n["n_name"].startswith(routes["route"]), "left")  # a constant route table
    return met.groupBy("n_name").agg(F.coalesce(F.max_by("page", F.length("route")), F.lit("none")).alias("page"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def flt13_not_expired(spark, sf_dir):
    """Rows that haven't expired at a stated time."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")


@query("SELECT count(*) AS n FROM part")
def flt8_path_guard(spark, sf_dir):
    """Paths that stay inside the root."""
    p = F.concat(F.lit("wiki/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".md"))
    bad = F.array(F.lit("../x"), F.lit("/etc/x"), F.lit("wiki/../../x"))
    rows = table(spark, sf_dir, "part").select(F.explode(F.concat(F.array(p), bad)).alias("path"))
    return rows.where(~F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)")).agg(F.count("*").alias("n"))
