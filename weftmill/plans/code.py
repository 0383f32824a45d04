"""Queries over code parsers: sources written from the star schema, so that the result is known in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmill.functions import rules as R
from weftmill.plans.registry import query, table
from weftmill.sources import code as P


def _files(rows, path, *lines):
    return rows.select(path.alias("file"), F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("source"))


@query("SELECT 'v' || p_partkey || '.cds' AS file, 'ZV_' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_ITEM' WHEN p_partkey % 3 = 1 THEN '_GROUP' ELSE '_X' END AS name, CAST(2 AS BIGINT) AS n_members, CASE WHEN p_partkey % 3 = 0 THEN 'Transaction Data' WHEN p_partkey % 3 = 1 THEN 'Master Data' ELSE 'unknown' END AS category, 'zsrc' AS source, '_A' AS association, CAST(NULL AS VARCHAR) AS warning FROM part")
def utf1_cds(spark, sf_dir):
    """CDS views: members, source, associations, category."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("ZV_"), k, F.when(k % 3 == 0, "_ITEM").when(k % 3 == 1, "_GROUP").otherwise("_X"))
    files = _files(table(spark, sf_dir, "part"), F.concat(F.lit("v"), k, F.lit(".cds")), "@Ui.hidden: 'x'", F.concat(F.lit("define view "), name), "  as select from zsrc", "  association [0..1] to zoo as _A on 1 = 1", "{", "  key a,", "  b", "}")
    v = P.parse_cds(files)
    return v.select("file", "name", F.size("members").cast("long").alias("n_members"), "category", F.col("source_tables")[0].alias("source"), F.col("associations")[0]["name"].alias("association"), "warning")


_ABAP_SQL = "SELECT 'p' || s_suppkey AS file, 'class' AS kind, 'zcl_' || s_suppkey AS name, 'run' AS method, 'dev/zcl_' || s_suppkey || '/run' AS path, 'table_read:zt' || s_suppkey || ',call_function:F_' || s_nationkey AS dependencies FROM supplier UNION ALL SELECT 'p' || s_suppkey, 'class', 'zcl_' || s_suppkey, 'stop', 'dev/zcl_' || s_suppkey || '/stop', 'call_form:bye,call_method:finish' FROM supplier"


def _abap(spark, sf_dir):
    k = F.col("s_suppkey")
    files = _files(
        table(spark, sf_dir, "supplier"), F.concat(F.lit("p"), k), F.concat(F.lit("CLASS zcl_"), k, F.lit(" IMPLEMENTATION.")), "  METHOD run.", F.concat(F.lit("    SELECT * FROM zt"), k, F.lit(" INTO TABLE x.")), "    SELECT * FROM other INTO y.",
        F.concat(F.lit("    CALL FUNCTION 'F_"), "s_nationkey", F.lit("'.")), "  ENDMETHOD.", "  METHOD stop.", "    PERFORM bye.", "    CALL METHOD me->finish.", "  ENDMETHOD.", "ENDCLASS.",
    )
    return P.parse_abap(files, "dev")


@query(_ABAP_SQL)
def utf2_abap(spark, sf_dir):
    """ABAP methods and their dependencies."""
    return _abap(spark, sf_dir).select("file", "kind", "name", "method", "path", F.array_join("dependencies", ",").alias("dependencies"))


@query(f"SELECT d AS dependency, count(*) AS n FROM (SELECT unnest(string_split(dependencies, ',')) AS d FROM ({_ABAP_SQL})) GROUP BY d")
def utf3_dependencies(spark, sf_dir):
    """How often each dependency occurs."""
    return _abap(spark, sf_dir).select(F.explode("dependencies").alias("dependency")).groupBy("dependency").agg(F.count("*").alias("n"))


@query("SELECT 'webapp/c' || n_nationkey || '.controller.js' AS file, 'controller' AS kind, 'go' AS method, 'app/c' || n_nationkey || '.controller/go' AS path, 'odata:/sap/x' || n_nationkey || ',odata:/rep,cds:ZBIG_' || n_nationkey AS refs FROM nation")
def utf4_ui5(spark, sf_dir):
    """UI5 controllers split by method, with references; test folders are left out."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    text = ("go: function (e) {", F.concat(F.lit("  this.read('/sap/x"), k, F.lit("');")), "  this.getModel('rep');", F.concat(F.lit("  bind('/ZBIG_"), k, F.lit("');")), "},")
    files = _files(n, F.concat(F.lit("webapp/c"), k, F.lit(".controller.js")), *text).unionByName(_files(n, F.concat(F.lit("webapp/test/c"), k, F.lit(".js")), *text))
    return P.parse_ui5(files, large=3).select("file", "kind", "method", "path", F.array_join("refs", ",").alias("refs"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'controller' WHEN 2 THEN NULL WHEN 3 THEN 'manifest' ELSE 'js' END AS kind FROM part")
def flt9_ui5_kind(spark, sf_dir):
    """Unit kinds of paths."""
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, "a/Main.view.xml").when(k == 1, "Report.controller.ts").when(k == 2, "x/node_modules/y.js").when(k == 3, "webapp/manifest.json").otherwise("u.TSX")
    return table(spark, sf_dir, "part").select("p_partkey", R.ui5_kind(path).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Transaction Data' WHEN p_partkey % 4 = 1 THEN 'Transaction Data' WHEN p_partkey % 4 = 2 THEN 'Master Data' ELSE 'unknown' END AS category FROM part")
def utf6_category(spark, sf_dir):
    """Data category by name, annotations and sources."""
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", R.data_category(F.when(k == 0, "ZJournal").when(k == 2, "zCompany").otherwise("zq"), F.when(k == 1, "@X: #T").otherwise(""), F.lit("zsrc")).alias("category"))
