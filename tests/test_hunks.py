"""Hunks against a whole-table programme, and the stated cases."""

import random

from weftmill.functions import hunks as H


def whole_table(x, y):
    n, m = len(x), len(y)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            t[i][j] = t[i + 1][j + 1] + 1 if x[i] == y[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(" ")
            i, j = i + 1, j + 1
        elif j == m or (i < n and t[i + 1][j] >= t[i][j + 1]):
            out.append("-")
            i += 1
        else:
            out.append("+")
            j += 1
    return out


def test_script_is_that_of_a_whole_table():
    rng = random.Random(1)
    for n in range(200):
        x, y = (rng.choices("abcd"[: 1 + n % 4], k=rng.randrange(14)) for _ in "xy")
        assert H.script(x, y) == whole_table(x, y)
    x, y = (rng.choices("abcdefgh", k=150) for _ in "xy")
    assert H.script(x, y) == whole_table(x, y)


def test_stated_cases():
    body = "# Title\n\nIntro.\n"
    assert H.line_hunks(body, body) == (False, [], "", 0, 0, False) == H.line_hunks(None, "")
    before = "# Runbook\n\n## Setup\n\nStart the service.\n\n## Recovery\n\nRestart."
    changed, hunks, unified, added, removed, structural = H.line_hunks(before, before.replace("Start the", "Stop the"))
    assert hunks == [(5, 5, ["Start the service."], ["Stop the service."])] and (changed, added, removed, structural) == (True, 1, 1, False)
    assert unified == "@@ -5,1 +5,1 @@\n-Start the service.\n+Stop the service."
    assert H.line_hunks("One.\nTwo.\nFour.\n", "One.\nTwo.\nThree.\nFour.\n")[1] == [(3, 3, [], ["Three."])]
    assert H.line_hunks("# Title\n\n## Setup\n\nbody\n", "# Title\n\n### Setup\n\nbody\n")[5]
    assert H.line_hunks("# Doc\r\n\r\nOne.\r\n", "# Doc\r\n\r\nTwo.\r\n")[1] == [(3, 3, ["One."], ["Two."])]
    big = ["\n".join(f"{w} line {i}" for i in range(1500)) for w in ("old", "new")]
    assert [len(h[2]) for h in H.line_hunks(*big)[1]] == [1500]
    two = H.line_hunks("a\nb\nc\nd\ne", "a\nB\nc\nd\nE\nF")
    assert two[1] == [(2, 2, ["b"], ["B"]), (5, 5, ["e"], ["E", "F"])] and two[2] == "@@ -2,1 +2,1 @@\n-b\n+B\n@@ -5,1 +5,2 @@\n-e\n+E\n+F"


def test_columns(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), (None, None)], "x string, y string").select(H.diff_hunks("x", "y").alias("d")).select("d.*")
    first, second = df.collect()
    assert [tuple(h) for h in first.hunks] == [(2, 2, ["b"], ["c"])] and not second.changed


def test_diffs_of_a_batch_are_made_a_few_rows_at_a_time():
    import pyarrow as pa

    from weftmill.functions import hunks as H

    a, b = [None if i == 5 else f"mark-{i}\nx" for i in range(20)], [f"mark-{i}\ny" for i in range(20)]
    out = H._diffs(pa.array(a), pa.array(b), 3).to_pylist()
    assert [(r["unified"], r["added"], r["removed"]) for r in out] == [(H.line_hunks(p, q)[2:5]) for p, q in zip(a, b, strict=True)]
    assert H._diffs(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_large_middles_get_their_least_script():
    """More than two million cells: lines that both texts have are kept as in small texts."""
    x, y = ([f"same {i}" if i % 3 == 1 else f"{w} {i}" for i in range(1600)] for w in ("old", "new"))
    changed, hunks, _, added, removed, _ = H.line_hunks("\n".join(x), "\n".join(y))
    assert changed and len(hunks) == 534 and added == removed == 1067 and hunks[1] == (3, 3, ["old 2", "old 3"], ["new 2", "new 3"])
    rng = random.Random(3)
    x, y = (["first " + w, *rng.choices([f"line {i}" for i in range(40)], k=n), "last " + w] for w, n in (("a", 1500), ("b", 1450)))
    steps = whole_table(x, y)
    assert H.script(x, y) == H.script(x, y, 5000) == steps
    assert H.line_hunks("\n".join(x), "\n".join(y))[3:5] == (steps.count("+"), steps.count("-"))


def test_script_does_not_depend_on_what_is_kept():
    rng = random.Random(4)
    for n in range(300):
        x, y = (rng.choices("abcdefgh"[: 1 + n % 8] + extra, k=rng.randrange(40)) for extra in ("", "xyz"[: n % 4]))
        assert H.script(x, y, 1) == H.script(x, y, 30) == H.script(x, y) == whole_table(x, y)


def test_query_on_a_long_text(spark, tmp_path):
    import duckdb

    from weftmill.plans import facade, registry

    texts = [(1, "\n".join(f"row {i % 50}" for i in range(4000))), (2, "short\ntext"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in facade.txt23_hunks(spark, f"file://{tmp_path}").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.SQL["txt23_hunks"]).fetchall()) and got[0][1] > 1000
