"""Merged sections, deleted pages, retried stages, superseded connections: stated cases."""

import pytest

from weftmill.operators import pages as P
from weftmill.operators import refine as R
from weftmill.operators import stages as G


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sections_merge(spark):
    sections = spark.createDataFrame([("d", 0, " # A\n\naa ", "", True, 0.9, "auto_accept"), ("d", 1, "# B\n\nbb", "B.", False, 0.5, "review_required"), ("d", 2, None, None, None, None, None), ("e", 0, "", None, None, None, None)], "doc string, pos int, markdown string, summary string, complete boolean, confidence double, action string")
    assert rows(R.documents(sections), "doc") == [("d", "# A\n\naa\n\n# B\n\nbb", "B.", False, 0.7, True), ("e", "", "", True, 0.0, False)]
    chunks = spark.createDataFrame([("d", 0, 0, "c1", "aa"), ("d", 1, 0, "c1", "bb"), ("d", 1, 1, "c2", "cc"), ("d", 3, 0, "x", "dd"), ("e", 0, 0, "c1", "z")], "doc string, pos int, at int, id string, text string")
    assert [(r.text, r.new_id) for r in R.renumbered(chunks).orderBy("doc", "pos", "at").collect()] == [("aa", "c1"), ("bb", "c2"), ("cc", "c3"), ("dd", "c4"), ("z", "c1")]
    refs = spark.createDataFrame([("d", 1, "c2", "k"), ("d", 1, "c9", "gone"), ("d", 3, "x", "m")], "doc string, pos int, id string, what string")
    assert [(r.what, r.new_id) for r in R.remapped(refs, chunks).orderBy("what").collect()] == [("k", "c3"), ("m", "c4")]
    names = spark.createDataFrame([("d", 0, 0, "ACME", "org", "first"), ("d", 0, 1, "acme", "org", "dup"), ("d", 1, 0, "Acme", None, None), ("d", 1, 1, "", None, None), ("e", 0, 0, "acme", "org", None)], "doc string, pos int, at int, name string, type string, description string")
    assert [(r.doc, r.name, r.description) for r in R.entities(names).orderBy("doc").collect()] == [("d", "ACME", "first"), ("e", "acme", None)]
    rel = spark.createDataFrame([("d", 0, 0, "A", "B", ["h"], "x"), ("d", 1, 0, "A", "B", ["h"], "y"), ("d", 1, 1, "A", "B", None, "z"), ("d", 1, 2, None, "B", None, "z")], "doc string, pos int, at int, source string, target string, keywords array<string>, description string")
    assert [r.description for r in R.relations(rel).orderBy("pos", "at").collect()] == ["x", "z"]
    titled = spark.createDataFrame([("d", 0, 0, "A", " "), ("d", 1, 0, " a ", "Said."), ("d", 1, 1, "B", None)], "doc string, pos int, at int, title string, summary string")
    assert [(r.title, r.summary) for r in R.section_summaries(titled).orderBy("pos", "at").collect()] == [(" a ", "Said."), ("B", None)]
    assert R.renumbered(chunks.limit(0)).count() == R.documents(sections.limit(0)).count() == 0


def test_emptied_folders(spark):
    pages = spark.createDataFrame([("wiki/a/b/x.md",), ("wiki/a/b/y.md",), ("wiki/a/z.md",), ("wiki/c/d/e/q.md",), ("top.md",), (None,)], "path string")

    def gone(*paths):
        kept, folders = P.delete(pages, spark.createDataFrame([(p,) for p in paths], "path string"))
        return sorted(r.path for r in kept.collect()), sorted((r.folder, r.pages) for r in folders.collect())

    assert gone("wiki/a/b/x.md", "missing.md", None)[1] == []
    assert gone("wiki/a/b/x.md", "wiki/a/b/y.md", "top.md")[1] == [("wiki/a/b", 2)]
    assert gone("wiki/c/d/e/q.md") == (["top.md", "wiki/a/b/x.md", "wiki/a/b/y.md", "wiki/a/z.md"], [("wiki/c", 1), ("wiki/c/d", 1), ("wiki/c/d/e", 1)])
    assert [f for f, _ in gone("wiki/a/b/x.md", "wiki/a/b/y.md", "wiki/a/z.md", "wiki/c/d/e/q.md")[1]] == ["wiki", "wiki/a", "wiki/a/b", "wiki/c", "wiki/c/d", "wiki/c/d/e"]


def test_retry_restarts_what_hangs_on_a_failed_stage(spark):
    states = [(1, "parsing", "failed", 0), (2, "ingesting_wiki", "failed", 0), (2, "parsing", "done", 0), (3, "parsing", "failed", 0), (3, "refinement", "running", 0), (4, "parsing", "done", 0), (5, "refinement", "failed", 0), (5, "refinement", "done", 1), (6, "refinement", "failed", 1), (7, "unknown", "failed", 0)]
    got = {r.task: (r.outcome, r.restarted) for r in G.retry(spark.createDataFrame(states, "task int, stage string, status string, at int")).collect()}
    assert got[1] == ("retried", ["parsing", "refinement", "ingesting_wiki", "ingesting_graph"]) and got[2] == ("retried", ["ingesting_wiki"])
    assert got[3] == ("busy", []) and got[4] == got[5] == ("nothing", []) and got[6] == ("retried", ["refinement", "ingesting_wiki", "ingesting_graph"])
    with pytest.raises(ValueError, match="depend"):
        G.closure(spark, {"a": ("b",), "b": ("a",)})


def test_a_newer_connection_fails_tasks_in_flight(spark):
    frames = [("x", 0, "dispatch", None, "early"), ("x", 1, "register", "c1", None), ("x", 2, "dispatch", None, "t1"), ("x", 3, "dispatch", None, "t2"), ("x", 4, "complete", None, "t1"), ("x", 5, "register", "c2", None), ("x", 6, "complete", None, "t2"), ("x", 7, "dispatch", None, "t3"), ("y", 1, "register", "c9", None), ("y", 2, "dispatch", None, "t4"), ("y", 3, "error", None, "t4")]
    df = spark.createDataFrame([(a, at, at, k, c, t) for a, at, k, c, t in frames], "agent string, at int, tie int, kind string, connection string, task string")
    assert rows(G.superseded(df), "task") == [("t1", "x", "c1", "complete", 4), ("t2", "x", "c1", "superseded", 5), ("t3", "x", "c2", "open", None), ("t4", "y", "c9", "error", 3)]
