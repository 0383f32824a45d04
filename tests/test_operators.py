"""Operators on small literals: paths, patches, rules, states, merges, streams."""

from pyspark.sql import functions as F

from weftmill.functions import rules as R
from weftmill.functions import text as X
from weftmill.operators import board as B
from weftmill.operators import chunking as C
from weftmill.operators import graph as G
from weftmill.operators import mutations as M
from weftmill.operators import retrieval as S
from weftmill.sources import code as P


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_heading_paths_pop_deeper_levels(spark):
    md = "intro\n\n# A\n\np1\nstill p1\n\n### C\n\np2\n\n## B\n\np3\n\n# D\n\np4"
    rows = C.chunks(C.blocks(spark.createDataFrame([(1, md)], "doc_id int, md string"))).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.heading_path, r.text) for r in rows] == [("c1", "", "intro"), ("c2", "A", "p1\nstill p1"), ("c3", "A / C", "p2"), ("c4", "A / B", "p3"), ("c5", "D", "p4")]


def test_sections_and_split_level(spark):
    found = C.blocks(spark.createDataFrame([(1, "pre\n\n# A\n\nx\n\n# B\n\ny"), (2, "## only\n\nz")], "doc_id int, md string"))
    assert {(r.doc_id, r.section): r.title for r in C.sections(found).collect()} == {(1, 0): None, (1, 1): "A", (1, 2): "B", (2, 0): None}
    assert {r.doc_id: r.split_at for r in C.split_level(found).collect()} == {1: 1, 2: 2}


def test_greedy_groups(spark):
    assert one(spark, C.greedy_groups(F.array(*[F.lit(x) for x in (5, 5, 1, 20, 1)]), 10)) == [0, 0, 1, 2, 3]


def test_normalization_and_topics(spark):
    md = "---\na: b\n---\n# Head\n\n* **Bold** [label](u) ![i](s)\n> q\n1. one | two `c` <!-- x -->\n```\ncode\n```\nend , yes"
    assert one(spark, X.normalize_markdown(F.lit(md))) == "head bold label q one two c end, yes"
    assert one(spark, X.normalize_topic(F.lit(" SAP // Group Reporting/ -x- "))) == "sap/group-reporting/x"
    assert one(spark, X.normalize_topic(F.lit("///"))) is None
    assert one(spark, R.local_topic(F.lit("The S/4HANA move"), F.lit(""))) == "sap/migration/s4hana"
    assert one(spark, R.local_topic(F.lit("sacs and über"), F.lit(""))) is None
    assert one(spark, X.token_estimate(F.lit("abcde漢字"))) == 4


def test_review_precedence(spark):
    def decide(conf, reads, updated, retopic=None, reclassify=None, reinforce=False):
        c = R.review(F.lit(conf), F.lit(reads), F.lit(updated), F.lit("2024-07-01"), F.lit("a"), F.lit(retopic), F.lit("report"), F.lit(reclassify), F.lit(reinforce))
        r = one(spark, c)
        return r.action, r.confidence, r.archive

    assert decide(1.0, 0, "2024-07-01") == ("none", 1.0, False)
    assert decide(1.0, 5, "2024-06-21") == ("deprecate", 0.99, False)
    assert decide(0.7, 0, "2023-07-01") == ("deprecate", 0.167, True)
    assert decide(0.7, 3, "2023-07-02", reinforce=True)[0] == "reinforce"
    assert decide(0.7, 0, "2020-01-01", retopic="b/c", reclassify="manual")[0] == "retopic"
    assert decide(0.7, 0, "2020-01-01", retopic="Not Valid", reclassify=" Manual ")[0] == "reclassify"
    assert decide(0.5, 0, None) == ("none", 0.5, False)


def test_rank_fusion_adds_repeats(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 0), (1, 11, 0.8, 1)], "qid long, id long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 5.0, 0), (1, 11, 5.0, 1), (1, 12, 4.0, 2)], "qid long, id long, score double, rank int")
    rows = S.rrf([a, b], 5).orderBy("rank").collect()
    assert [(r.id, r.score, r.source) for r in rows] == [(11, 0.8, 0), (10, 0.9, 0), (12, 4.0, 1)]
    assert abs(rows[0].fused - (1 / 62 + 1 / 61 + 1 / 62)) < 1e-8


def test_mentions_in_several_automata(spark):
    chunks = spark.createDataFrame([(1, "The Alpha-Beta plan"), (2, "gamma"), (3, None)], "id long, text string")
    ents = spark.createDataFrame([("alpha", ["beta"]), ("Gamma", None)], "entity string, aliases array<string>")
    for most in (100, 1):
        assert {(r.entity, r.id) for r in S.mentions(chunks, ents, most).collect()} == {("alpha", 1), ("Gamma", 2)}


def test_cosine_edge_cases(spark):
    f = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, S.cosine(f(0, 0), f(1, 1))) == 0.0
    assert abs(one(spark, S.cosine(f(1, 0, 9), f(1, 0))) - 1) < 1e-12


def test_upsert_keeps_counters(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "id int, name string, reads int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string")
    got = {r.id: (r.name, r.reads) for r in M.upsert(old, new, ["id"], {"reads": F.lit(0)}, ("reads",)).collect()}
    assert got == {1: ("a", 5), 2: ("B", 7), 3: ("C", 0)}


def test_graph_changes(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, hash string")
    new = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "id int, hash string")
    assert {r.id: r.change for r in G.classify_change(old, new).collect()} == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}


def test_board_dispatch_and_pull(spark):
    t = spark.createDataFrame([("G1.S1.T1", "done", "", []), ("G1.S1.T2", "backlog", "", ["G1.S1.T1"]), ("G1.S1.T10", "backlog", "", ["G1.S1.T9"]), ("G1.S1.T3", "backlog", "x", []), ("G1.S1.T4", "canceled", "", []), ("G1.S1.T5", "backlog", "", ["G1.S1.T4"])], "ref string, status string, assignee string, blocked_by array<string>")
    assert [r.ref for r in B.claimable(t).collect()] == ["G1.S1.T2"]
    assert [r.ref for r in t.orderBy(*B.natural(F.col("ref"))).collect()][-1] == "G1.S1.T10"
    cards = spark.createDataFrame([("G1.S1.T2: x", "In Progress"), ("G1.S1.T1", "Done"), ("G1.S1.T3", "Approved"), ("G1.S1.T1x", "Done")], "title string, option string")
    assert {r.title: r.verdict for r in B.pull_status(t, cards).collect()} == {"G1.S1.T2: x": "apply", "G1.S1.T1": "unchanged", "G1.S1.T3": "conflict", "G1.S1.T1x": "unknown_ticket"}


def test_code_parsers():
    v = P.cds_views("@A.b: 'x'\ndefine view entity ZV\n as select from src\n association [1] to tgt as _T\n{\n key f,\n g\n}\n;where\ndefine view open\n{\n a")
    assert [x["name"] for x in v] == ["ZV", "open"] and v[0]["members"] == ["key f", "g"] and v[0]["annotations"] == ["@A.b: 'x'"] and v[1]["warning"] == "UNCLOSED_BRACE"
    units = P.abap_units("REPORT zr.\nFORM a.\n PERFORM b.\nENDFORM.\nFORM c.\n x", "dev")
    assert [(u["method"], u["warning"]) for u in units] == [("a", None), ("c", "UNCLOSED_FORM")] and units[0]["dependencies"] == ["call_form:b"]
    assert [u["kind"] for u in P.abap_units("REPORT zr.\nWRITE x.")] == ["report"] and P.abap_units("nothing") == []
    assert P.ui5_units("a/test/x.js", "x") == [] and P.ui5_units("m.js", "  ") == []
    big = "go: function () {\n" + "x;\n" * 500 + "},\nstop() {\n}\n"
    assert [u["method"] for u in P.ui5_units("webapp/controller/R.controller.js", big)] == ["go", "stop"]


def test_registered_fold_reaches_past_the_opening(spark, tmp_path):
    from weftmill.plans.registry import QUERIES

    spark.createDataFrame([(1, "x" * 250 + " É END ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["txt4_fold"](spark, str(tmp_path)).first().folded == "x" * 250 + " e end"


def test_registered_two_hops_take_every_customer(spark, tmp_path):
    from weftmill.plans.registry import QUERIES

    orders = [(1, 500), (2, 500), (700, 500), (3, 7), (900, 8)] + [(k, 900) for k in range(1000, 1300)] + [(4, 900)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    near, want = {}, set()
    for o, c in orders:
        near.setdefault(c, set()).add(-o)
        near.setdefault(-o, set()).add(c)
    for root in {x for o, c in orders if o <= 100 for x in (c, -o)}:
        one = near[root]
        two = {x for n in one for x in near[n]} - one - {root}
        want |= {(root, root, 0)} | {(root, x, 1) for x in one} | {(root, x, 2) for x in two}
    assert sorted(tuple(r) for r in QUERIES["ret14_two_hops"](spark, str(tmp_path)).collect()) == sorted(want)


def test_positions_and_column_rows_of_whole_tables(spark):
    import random

    keys = [(i % 3 or None, i) for i in range(5000)]
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame(keys, "a long, b long")
    got = {(r.a, r.b): r.position for r in B.positions(rows, [F.col("a"), F.col("b")]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys, key=lambda k: (k[0] or -1, k[1])))}
    assert B.positions(rows.limit(0), [F.col("a")]).count() == 0
    cards = rows.select(F.when(F.col("a") == 1, "Done").when(F.col("a") == 2, "Backlog").otherwise("Odd").alias("status"), F.col("b").alias("pos"), F.concat(F.lit("r"), "b").alias("ref"))
    listed = {(r.ordinal, r.status, i, ref) for r in B.columns(cards).collect() for i, ref in enumerate(r.cards)}
    assert {tuple(r) for r in B.column_rows(cards).select("ordinal", "status", "position", "ref").collect()} == listed


def test_patches_fold_in_order_and_without_a_group_for_each_document(spark):
    grid = [(1, 0, "heading", 1, "A"), (1, 1, "paragraph", 0, "p"), (2, 1, "paragraph", 0, "q"), (2, 0, "heading", 2, "B"), (None, 0, "heading", 1, "N"), (3, 0, "paragraph", 0, None)]
    ops = [(1, 3, "set_heading", 0, "A3", None), (1, 2, "set_heading", 0, "A2", None), (1, 4, "insert_after", 0, "new", None), (1, 5, "delete", 1, None, None), (1, 6, "set_text", 1, "gone", None), (2, 1, "set_level", 0, None, 9), (2, 2, "set_text", 0, "no", None), (2, 3, "delete", None, None, None), (None, 1, "set_heading", 0, "M", None), (9, 1, "insert_after", 0, "x", None)]
    out = C.apply_patches(spark.createDataFrame(grid, "doc_id long, pos int, kind string, level int, text string"), spark.createDataFrame(ops, "doc_id long, seq int, op string, index int, text string, level int"))
    want = {(1, 0, "heading", 1, "A3"), (1, 1, "paragraph", 0, "new"), (2, 0, "heading", 6, "B"), (2, 1, "paragraph", 0, "q"), (None, 0, "heading", 1, "M"), (3, 0, "paragraph", 0, None)}
    assert {tuple(r) for r in out.collect()} == want and "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_split_once_for_all_its_hashes(spark):
    import hashlib

    rows = spark.createDataFrame([(0, "a b c d e"), (1, None), (2, "")], "i int, t string").select("i", X.chunk_hashes(X.normalize_markdown(F.col("t")), 2).alias("h"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [r.h for r in rows.orderBy("i").collect()] == [[sha("a b"), sha("c d"), sha("e")], None, [sha("")]]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
