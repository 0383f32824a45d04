"""Front matter, diffs, term expansion, file scans, the paged source, the search facade."""

import json

import pytest
from pyspark.sql import functions as F

from weftmill.functions import udf as U
from weftmill.operators import search as Q
from weftmill.sources import files, paged


def test_board_frontmatter():
    fields, body = U.board_frontmatter('---\r\nid: G1\ntitle: "a: b"\npr: -7\nblocked_by: [G1.S1.T1, \'x\']\nowner:\nacceptance_criteria:\n  - one\n  - 2\n---\n# Body\n')
    assert fields == {"id": "G1", "title": "a: b", "pr": -7, "blocked_by": ["G1.S1.T1", "x"], "owner": [], "acceptance_criteria": ["one", 2]}
    assert body == "# Body\n" and U.board_frontmatter("plain") == ({}, "plain") and U.board_frontmatter(None) == ({}, "")
    assert U.board_frontmatter(U.render_board({"id": "T1", "blocked_by": ["a", "b"]}, "x"))[0] == {"id": "T1", "blocked_by": ["a", "b"]}


def test_patch_frontmatter():
    page = "---\ntype: report\nupdated: 2020-01-01\n---\nbody"
    assert U.patched_frontmatter(page, {"topic": "a/b"}, "2024-05-06") == "---\ntype: report\nupdated: 2024-05-06\ntopic: a/b\n---\nbody"
    assert U.patched_frontmatter("bare", {}, "2024-05-06") == "---\nupdated: 2024-05-06\n---\nbare"


@pytest.mark.parametrize(
    ("before", "after", "added", "removed", "structural"),
    [("a\nb", "a\nb", 0, 0, False), ("a\nb\nc", "a\nx\nc", 1, 1, False), ("# t\nb", "# u\nb", 1, 1, True), ("a\r\nb", "a\nb", 0, 0, False), ("", "a", 1, 1, False)],
)
def test_line_diff(before, after, added, removed, structural):
    d = U.line_diff(before, after)
    assert (d["added"], d["removed"], d["structural"]) == (added, removed, structural)
    assert (d["unified"] == "") == (added == removed == 0)


def test_large_diff_is_one_replacement():
    a, b = "\n".join(f"a{i}" for i in range(60)), "\n".join(f"b{i}" for i in range(60))
    assert U.line_diff(a, b, most_cells=100)["added"] == 60


def test_term_expansion(spark):
    m = [("group reporting", ["SAP GR"]), ("bw", ["A", "B"])]
    assert U.expanded("Use Group-Reporting and groupreporting, not subgroup reporting", m) == "Use SAP GR and SAP GR, not subgroup reporting"
    assert U.expanded("BW bw4 b w", m) == "(A OR B) bw4 (A OR B)"
    q = spark.createDataFrame([(1, "the bw"), (2, None)], "qid int, query string")
    maps = spark.createDataFrame([("bw", ["X"])], "term string, canonicals array<string>")
    assert {r.qid: r.expanded for r in U.expand_terms(q, maps).collect()} == {1: "the X", 2: ""}


def test_log_functions(spark):
    df = spark.createDataFrame([("body",)], "b string")
    once = df.select(U.append_log(F.col("b"), F.lit("first")).alias("b"))
    assert once.select(U.append_log(F.col("b"), F.lit("second"))).first()[0] == "body\n\n## Log\n\n- first\n- second\n"
    prog = df.select(U.insert_progress(F.col("b"), F.lit("| 1 | a | old |")).alias("b")).select(U.insert_progress(F.col("b"), F.lit("| 2 | b | new |")).alias("b"))
    text = prog.first()[0]
    assert text.index("new") < text.index("old")
    assert prog.select(U.strip_progress(F.col("b"))).first()[0].strip() == "body"


def test_diff_udf(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), (None, None)], "x string, y string")
    assert [tuple(r)[:2] for r in df.select(U.diff("x", "y").alias("d")).select("d.*").collect()] == [(1, 1), (0, 0)]


def test_board_scan(spark, tmp_path):
    def put(path, layer):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"---\nlayer: {layer}\ntitle: t\n---\nbody of {path}\n")

    for path, layer in (("G1/Goal.md", "G"), ("G1/S1/Spec.md", "S"), ("G1/S1/T2.md", "T"), ("G1/S1/T10/T10.md", "T"), ("G1/S2/T1.md", "S"), ("G1/notes.md", "X")):
        put(path, layer)
    (tmp_path / "G1/S1/T3.md").write_text("nothing")
    rows = {r.ref: r for r in files.scan_board(spark, f"file://{tmp_path}", include_body=True).collect()}
    assert set(rows) == {"G1", "G1.S1", "G1.S1.T2", "G1.S1.T10", "G1.S1.T3", "G1.S2.T1"}
    assert rows["G1.S1.T3"].error == "no front matter" and rows["G1.S2.T1"].error and rows["G1.S1.T2"].error is None
    assert json.loads(rows["G1"].frontmatter)["title"] == "t" and "T10" in rows["G1.S1.T10"].body
    assert {r.ref for r in files.scan_board(spark, f"file://{tmp_path}", "G1.S2").collect()} == {"G1", "G1.S2.T1"}


def test_wiki_pages_and_sinks(spark, tmp_path):
    for name, text in (("a/x-y.md", "---\ntype: report\ntopic: a/b\n---\n# Title\n"), ("plain_page.md", "text"), ("index.md", "i"), (".hidden.md", "h")):
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(text)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.wiki_pages(spark, f"file://{tmp_path}/w").collect()}
    assert set(rows) == {"x-y.md", "plain_page.md"}
    assert (rows["x-y.md"].type, rows["x-y.md"].topic, rows["x-y.md"].title) == ("report", "a/b", "Title") and rows["plain_page.md"].title == "plain page"
    pages = spark.createDataFrame([("report", "a/b", "reports", "T", "B"), ("event", None, "events", "U", "C")], "category string, topic string, folder string, title string, body string")
    files.write_wiki(pages, f"file://{tmp_path}/out")
    back = {r.dir: r.page for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert set(back) == {"a/b", "events"} and back["a/b"].startswith("---\ntype: report\n")
    ref = files.write_chunks(spark.createDataFrame([(1, "ab"), (1, "é")], "doc_id int, text string"), f"file://{tmp_path}/chunks").first()
    assert (ref.chunks, ref.bytes) == (2, 4)


def test_search_results(spark):
    hit = '<a class="result__a" href="//x/l/?uddg=https%3A%2F%2Fe.org%2Fp&rut=1">A &amp; <b>B</b></a> <a class="result__snippet" q>S &lt;1&gt;</a>'
    bad = '<a class="result__a" href="//x/l/?uddg=ftp%3A%2F%2Fe">T</a><a class="result__snippet">u</a><a class="result__a" href="//x/?uddg=https%3A%2F%2Fq">no snippet</a>'
    rows = files.search_results(spark.createDataFrame([(1, hit + bad), (2, "")], "page_id int, html string")).collect()
    assert [(r.page_id, r.title, r.url, r.snippet) for r in rows] == [(1, "A & B", "https://e.org/p", "S <1>")]


def test_paged_source(spark):
    paged.register(spark)
    rows = spark.read.format("paged").options(fetch="weftmill.sources.paged:sample_fetch", resource="issues", pages=4).load()
    assert rows.count() == 230 and rows.select(F.from_json("item", "number long, state string").alias("i")).where("i.state = 'closed'").count() == 77
    assert rows.select(F.max("page")).first()[0] == 3


@pytest.mark.parametrize("most", [1, 2, 3, 4, 100])
def test_mappings_in_parts_apply_in_order(spark, most):
    rows = [("b", ["c"]), ("a", ["b"]), ("d", ["e", "f"]), ("c", ["d"]), ("g", ["g g"]), ("g", ["g g"]), ("é", ["z"]), ("h", [])]
    q = spark.createDataFrame([(1, "a x"), (2, None), (3, "g é h")], "qid long, text string")
    want = {r[0]: U.expanded(r[1] or "", sorted(rows)) for r in q.collect()}
    got = U.expand_terms(q, spark.createDataFrame(rows, "term string, canonicals array<string>"), "text", most_mappings=most)
    assert got.columns == ["qid", "text", "expanded"] and {r.qid: r.expanded for r in got.collect()} == want and want[1] == "(e OR f) x"
    assert U.expand_terms(q, spark.createDataFrame([], "term string, canonicals array<string>"), "text", most_mappings=most).count() == 3


def test_a_list_of_more_mappings_than_one_part_keeps_its_last(spark):
    name = F.when(F.col("id") >= 100_000, F.array(F.concat(F.lit("n"), "id"))).otherwise(F.array().cast("array<string>"))  # those without names cost no time
    maps = spark.range(100_001).select(F.format_string("t%06d", "id").alias("term"), name.alias("canonicals"))
    assert U.expand_terms(spark.createDataFrame([("t100000 and t000000",)], "query string"), maps).first().expanded == "n100000 and t000000"


@pytest.mark.parametrize(("pages", "size"), [(None, 100), (1, 10), (2, 50), (2, 115), (4, 100), (9, 100)])
def test_paged_source_reads_past_the_planned_pages(spark, pages, size):
    paged.register(spark)
    options = {"fetch": "weftmill.sources.paged:sample_fetch", "size": size} | ({"pages": pages} if pages else {})
    rows = spark.read.format("paged").options(**options).load().select("page", F.from_json("item", "number int")["number"].alias("n")).collect()
    assert sorted((r.page, r.n) for r in rows) == [(i // size + 1, i) for i in range(230)]


def test_search_facade(spark):
    chunks = spark.createDataFrame([(1, "red apple pie", "food/pie", "s"), (2, "green apple", "food/raw", "s"), (3, "car engine", "tech", "t")], "id long, text string, topic string, section string")
    corpus = Q.Corpus(chunks, mappings=spark.createDataFrame([("auto", ["car"])], "term string, canonicals array<string>"))
    asked = spark.createDataFrame([(1, "apple pie"), (2, "auto")], "qid long, text string")
    hits = {(r.qid, r["rank"]): r.id for r in Q.search(asked, corpus).collect()}
    assert hits == {(1, 0): 1, (1, 1): 2, (2, 0): 3}
    assert {r.id for r in Q.search(asked, corpus, scope="food/raw").collect()} == {2}
    assert Q.search(asked, corpus, how="vector").count() == 0
    assert {r.id: r.siblings for r in Q.search(asked, corpus, enrich=True).collect()}[1] == [2]
    assert Q.retriever("bm25", "graph") == "bm25" and Q.retriever(None, "graph") == "graph" and Q.retriever("odd") == "hybrid"
    plans = Q.Planner().answer(spark.createDataFrame([(1, "apple pie and car engine"), (2, "hm"), (3, "what is apple?")], "qid long, text string"), corpus).collect()
    got = {r.qid: (r.plan, r.hits) for r in plans}
    assert got[1] == ("decompose", [1, 2, 3]) and got[2] == ("clarify", []) and got[3][0] == "direct"


def test_loose_relations_are_parsed_once(spark):
    from weftmill.functions.text import relation_of

    texts = ['{"source": " a", "target": "b", "keywords": ["k"]}', 'so: {"from": "a", "to": "b "} end', '```json\n{"from": "c", "to": "d"}\n``` {', "none", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", relation_of(F.col("t")).alias("r")).select("i", "r.*")
    assert [tuple(r)[1:] for r in rows.orderBy("i").collect()] == [("a", "b", ["k"]), ("a", "b", []), ("c", "d", []), (None, None, []), (None, None, [])]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_sources_are_dealt_out_before_they_are_parsed(spark):
    from weftmill.sources import code

    files = spark.createDataFrame([(f"v{i}.cds", f"define view V{i} as select from t\n{{\n  key a\n}}") for i in range(64)], "file string, source string").coalesce(1)
    parsed = code.parse_cds(files)
    assert parsed.rdd.getNumPartitions() > 1 and {r.name for r in parsed.collect()} == {f"V{i}" for i in range(64)}
