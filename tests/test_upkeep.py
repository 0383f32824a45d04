"""Pieces, moves, trees, renames, routing: stated cases."""

from pyspark.sql import functions as F

from weftmill.operators import upkeep as U


def test_sections_are_cut_at_paragraphs_and_nothing_is_lost(spark):
    long = "\n\n".join(["é" * 10, "b" * 15, "c" * 50, "d", "e" * 5])
    df = spark.createDataFrame([(1, "A > B", long), (2, "S", "short"), (3, None, None), (4, None, "x" * 30 + "\n\n\n" + "y")], "id int, heading_path string, markdown string")
    rows = {(r.id, r.piece): (r.heading_path, r.markdown) for r in U.enforce_size(df, 36).collect()}
    assert rows[1, 0] == ("A > B", "é" * 10 + "\n\n" + "b" * 15) and rows[1, 1] == ("A > B (part 2)", "c" * 50) and rows[1, 2] == ("A > B (part 3)", "d\n\n" + "e" * 5)
    assert rows[2, 0] == ("S", "short") and rows[3, 0] == (None, "") and rows[4, 0] == (None, "x" * 30 + "\n\n\ny")
    assert "\n\n".join(rows[1, i][1] for i in range(3)) == long and len(rows) == 6


def test_moves_keep_a_history(spark):
    pages = spark.createDataFrame([("wiki/a/x.md", "a", ["b"]), ("wiki/a/y.md", "a", ["a"]), ("wiki/z.md", None, None), ("wiki/p.txt", "a", None)], "path string, topic string, topic_history array<string>")
    moves = spark.createDataFrame([("wiki/a/x.md", " c/d "), ("wiki/a/y.md", "c"), ("wiki/z.md", "c"), ("wiki/p.txt", "c"), ("gone.md", "c"), ("wiki/a/x.md", "zz")], "path string, topic string")
    got = {r.path: (r.outcome, r.new_path, r.topic_history) for r in U.retopic(pages, moves, F.lit("2024-01-01")).collect()}
    assert got == {"wiki/a/x.md": ("moved", "wiki/c/d/x.md", ["b", "a"]), "wiki/a/y.md": ("moved", "wiki/c/y.md", ["a"]), "wiki/z.md": ("moved", "wiki/c/z.md", []), "wiki/p.txt": ("invalid path", None, None), "gone.md": ("missing", None, None)}
    bad = spark.createDataFrame([("wiki/a/x.md", "Not A Topic"), ("wiki/a/y.md", "a")], "path string, topic string")
    assert {r.path: r.outcome for r in U.retopic(pages, bad, F.lit("d")).collect()} == {"wiki/a/x.md": "invalid topic", "wiki/a/y.md": "same topic"}


def test_trees(spark):
    pages = spark.createDataFrame([("a/b", "event"), ("a", None), ("", "event"), (None, ""), ("a/b", "concept")], "topic string, type string")
    assert {(r.path, r.name, r.depth, r.pages, r.own) for r in U.topic_tree(pages).collect()} == {("a", "a", 0, 3, 1), ("a/b", "b", 1, 2, 2), ("untagged", "Untagged", 0, 2, 2)}
    assert {(r.path, r.name, r.pages) for r in U.type_tree(pages).collect()} == {("view:type:event", "event", 2), ("view:type:concept", "concept", 1), ("view:type:other", "Other", 2)}


def test_renames_and_touches(spark):
    s = spark.createDataFrame([("e", "1", "old", 1), ("e", "2", "old", 1), ("e", "", "legacy", 1), ("f", "1", "other", 1)], "owner string, session string, title string, updated_at int")
    c = spark.createDataFrame([("e", "1", "  " + "n" * 200), ("e", "2", None), ("e", "", "x"), ("f", "1", "  "), ("g", "1", "y")], "owner string, session string, title string")
    assert {(r.owner, r.session): (r.title, r.updated_at) for r in U.rename(s, c, F.lit(9)).collect()} == {("e", "1"): ("n" * 120, 9), ("e", "2"): ("old", 9), ("e", ""): ("legacy", 1), ("f", "1"): ("other", 1)}


def test_frames_of_unknown_tasks_are_dropped(spark):
    rows = [("a", 1, "frame"), ("a", 2, "open"), ("a", 3, "frame"), ("a", 4, "end"), ("a", 5, "frame"), ("a", 6, "open"), ("a", 7, "frame"), ("b", 1, "frame"), ("b", 2, "end")]
    df = spark.createDataFrame([(k, t, t, x) for k, t, x in rows], "task string, at int, tie int, kind string")
    out = U.routed(df, "task", "at", "tie", F.col("kind") == "open", F.col("kind") == "end")
    assert sorted((r.task, r.at) for r in out.collect()) == [("a", 2), ("a", 3), ("a", 4), ("a", 6), ("a", 7)]


def test_pieces_leave_python_in_slices(spark, monkeypatch):
    from weftmill.operators import upkeep as U

    monkeypatch.setattr(U, "SLICE", 2, raising=False)
    text = "aaaa\n\nbbbb\n\ncccc"
    rows = [(i, "h" if i % 2 else None, text if i % 3 else "short") for i in range(7)]
    out = U.enforce_size(spark.createDataFrame(rows, "i int, heading_path string, markdown string").coalesce(1), 9)
    want = [(i, k, h if k == 0 else f"{h or ''} (part {k + 1})", m) for i, h, t in rows for k, m in enumerate(["aaaa\n\nbbbb", "cccc"] if t == text else [t])]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == want
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
