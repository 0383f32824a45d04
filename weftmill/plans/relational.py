"""Queries over joins, sorts, sets and scalar rules of the inventory; those named ext_ are Spark built-ins beyond it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftmill.functions import rules as R
from weftmill.plans.registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0")
def jn2_left_joins(spark, sf_dir):
    """Chunk with section and page: two left joins."""
    line, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size > 25"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return line.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name")


@query("SELECT n_name, r_name, list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL)) AS near FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, r_name")
def jn3_neighbours(spark, sf_dir):
    """Mentions with the distinct neighbours of each entity."""
    n, r, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), table(spark, sf_dir, "supplier")
    near = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_set("s_name")).alias("near"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(near, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", "r_name", "near")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON lower(trim(' ' || upper(r_name) || ' ')) = lower(r_name) AND n_regionkey = r_regionkey")
def jn6_by_title(spark, sf_dir):
    """Summaries joined to sections on trimmed lower titles within a document."""
    r = table(spark, sf_dir, "region")
    summary = r.select(F.col("r_regionkey").alias("doc"), F.concat(F.lit(" "), F.upper("r_name"), F.lit(" ")).alias("title"))
    section = r.select(F.col("r_regionkey").alias("doc"), "r_name")
    met = summary.join(section, (summary["doc"] == section["doc"]) & (F.lower(F.trim("title")) == F.lower("r_name"))).select(section["doc"], "r_name")
    return table(spark, sf_dir, "nation").join(met, F.col("n_regionkey") == F.col("doc")).select("n_nationkey", "r_name")


@query("SELECT o_orderkey, coalesce(c_name, 'doc-' || o_custkey) AS document FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def jn8_resolve(spark, sf_dir):
    """Document of a path, with a fallback."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("doc-"), "o_custkey")).alias("document"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn16_declarations(spark, sf_dir):
    """Declarations with agent and owner."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'even' END AS topic FROM pages")
def jn19_prj2_page_metadata(spark, sf_dir):
    """Page metadata attached to tree nodes."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id").join(p.where("page_id % 2 = 0").select("page_id", F.lit("even").alias("topic")), "page_id", "left")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 't' || doc_id ELSE lang || '/' || source END AS topic FROM documents")
def flt3_topic_from_path(spark, sf_dir):
    """Topic of a hit, else the one in its path."""
    d = table(spark, sf_dir, "documents")
    known = d.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("t"), "doc_id").alias("topic"))
    path = F.concat(F.lit("wiki/"), "lang", F.lit("/"), "source", F.lit("/p"), "doc_id", F.lit(".md"))
    return d.select("doc_id", path.alias("path")).join(known, "doc_id", "left").select("doc_id", F.coalesce("topic", F.regexp_extract("path", r"^wiki/(.+)/[^/]+$", 1)).alias("topic"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 7")
def flt10_owner_state(spark, sf_dir):
    """Listings by owner and state."""
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_custkey") == 7)).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def src13_title_prefix(spark, sf_dir):
    """Look-up by title prefix, pushed to the scan."""
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey")


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'E' || label || ' → ' || (label + 1) ELSE 'chunk' END AS title FROM embeddings")
def prj1_hit_title(spark, sf_dir):
    """Titles of hits: graph hits show their entity and neighbours."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, F.concat(F.lit("E"), "label", F.lit(" → "), F.col("label") + 1)).otherwise("chunk").alias("title"))


@query("SELECT doc_id, list_sort(list_distinct([lang, source])) = list_sort(list_distinct([source, lang, lang])) AS same FROM documents")
def set3_same_set(spark, sf_dir):
    """Set equality of lists."""
    a, b = F.array("lang", "source"), F.array("source", "lang", "lang")
    return table(spark, sf_dir, "documents").select("doc_id", (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).alias("same"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set5_seen_union(spark, sf_dir):
    """Seen ids, idempotent."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).dropDuplicates(["id"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set6_stale(spark, sf_dir):
    """Set difference."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_name, p_partkey) AS n FROM part")
def srt8_titles(spark, sf_dir):
    """Titles in case-insensitive order within a group."""
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.lower("p_name"), "p_name", "p_partkey")).alias("n"))


@query("SELECT path, is_dir, row_number() OVER (PARTITION BY parent ORDER BY NOT is_dir, name) AS n FROM (SELECT DISTINCT lang AS path, true AS is_dir, '' AS parent, lang AS name FROM documents UNION ALL SELECT DISTINCT lang || '/' || source, CAST(right(source, 1) AS INTEGER) % 2 = 0, lang, source FROM documents)")
def srt9_srt14_tree(spark, sf_dir):
    """A path tree: every ancestor once, folders before files, then by name."""
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    nodes = d.select(F.explode(F.array(F.struct(F.col("lang").alias("path"), F.lit(True).alias("is_dir"), F.lit("").alias("parent"), F.col("lang").alias("name")), F.struct(F.concat_ws("/", "lang", "source").alias("path"), (F.right("source", F.lit(1)).cast("int") % 2 == 0).alias("is_dir"), F.col("lang").alias("parent"), F.col("source").alias("name")))).alias("n")).select("n.*").distinct()
    return nodes.select("path", "is_dir", F.row_number().over(Window.partitionBy("parent").orderBy(~F.col("is_dir"), "name")).alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def srt10_newest(spark, sf_dir):
    """The ten newest rows (a top-k report)."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_orderdate")


@query("SELECT c_mktsegment, arg_max(c_acctbal, c_custkey) AS last_balance FROM customer GROUP BY c_mktsegment")
def agg18_last_wins(spark, sf_dir):
    """Options by name: the later list overwrites."""
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max_by("c_acctbal", "c_custkey").alias("last_balance"))


@query("SELECT o_orderkey, " + "CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Backlog' ELSE 'In Progress' END AS option, o_orderstatus <> 'F' AS is_open FROM orders")
def dt10_status_map(spark, sf_dir):
    """Status to column and open state."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "backlog").otherwise("in_progress")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.lookup(status, R.COLUMNS).alias("option"), (~status.isin("done", "approved", "rejected", "canceled")).alias("is_open"))


@query("SELECT src, dst, direction FROM (SELECT n_name AS src, r_name AS dst, 'out' AS direction FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%1' UNION ALL SELECT n_name, r_name, 'in' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%')")
def ret15_node_relations(spark, sf_dir):
    """Relations out of and into nodes."""
    e = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return e.where("src LIKE '%1'").withColumn("direction", F.lit("out")).unionByName(e.where("dst LIKE 'A%'").withColumn("direction", F.lit("in")))


@query("SELECT r_regionkey, lower(r_name) AS label FROM region WHERE lower(r_name) = 'asia'")
def ret16_root(spark, sf_dir):
    """A root by label in any case."""
    return table(spark, sf_dir, "region").where(F.lower("r_name") == F.lower(F.lit("ASIA"))).select("r_regionkey", F.lower("r_name").alias("label"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""")
def ext_pricing(spark, sf_dir):
    """Extension: pricing summary."""
    line = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, sf_dir):
    """Extension: cube with its grouping id."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


@query("SELECT e.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS last_click FROM events e LEFT JOIN events b ON b.user_id = e.user_id AND b.event_type = 'click' AND (b.ts, b.event_id) <= (e.ts, e.event_id) WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def ext_asof(spark, sf_dir):
    """Extension: as-of join as a window over the union of both sides; no range join, one exchange."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_click", last).where("event_type = 'purchase'").select("event_id", "last_click")


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def ext_set_algebra(spark, sf_dir):
    """Extension: intersect and except."""
    o = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(o.where("o_totalprice > 300000").select("o_custkey")).exceptAll(o.where("o_orderstatus = 'P'").select("o_custkey").distinct())
