"""Board files written as columns read back equal; patches keep order, other keys and the body."""

import json

from pyspark.sql import functions as F

from weftmill.functions import boards as B
from weftmill.functions.udf import parse_board


def test_board_files_read_back_equal(spark):
    rows = [(1, 'A "quoted" title: yes', ["G1.S1", "with space"], [], None, "body"), (2, "plain", None, ["x"], 7, "b\n"), (3, "", ["a"], None, 0, None)]
    df = spark.createDataFrame(rows, "id int, title string, blocked array<string>, labels array<string>, pr int, body string")
    text = B.board_file({"title": (F.col("title"), "string"), "blocked_by": (F.col("blocked"), "array<string>"), "labels": (F.col("labels"), "array<string>"), "pr": (F.col("pr"), "int")}, F.col("body"))
    out = {r.id: (r.text, json.loads(r.p.frontmatter), r.p.body) for r in df.select("id", text.alias("text")).select("id", "text", parse_board("text").alias("p")).collect()}
    assert out[1][0] == '---\ntitle: "A \\"quoted\\" title: yes"\nblocked_by:\n  - "G1.S1"\n  - "with space"\nlabels: []\n---\n\nbody\n'
    assert out[1][1] == {"title": out[1][1]["title"], "blocked_by": ["G1.S1", "with space"], "labels": []} and out[2][1] == {"title": "plain", "labels": ["x"], "pr": 7}
    assert out[3][1] == {"title": "", "blocked_by": ["a"], "pr": 0} and out[2][2].strip() == "b"


def test_patches(spark):
    df = spark.createDataFrame([(1, "---\ntitle: T\nconfidence: 0.5\nupdated: old\n---\nBody --- x\n---\n"), (2, "no front matter"), (3, None), (4, "---\r\na: 1\r\n---\r\nb")], "id int, text string")
    out = {r.id: r.t for r in df.select("id", B.patched(F.col("text"), {"confidence": F.lit("0.9"), "topic": F.lit("a/b"), "type": F.lit(None).cast("string")}, F.lit("2024-05-05")).alias("t")).collect()}
    assert out[1] == "---\ntitle: T\nconfidence: 0.9\nupdated: 2024-05-05\ntopic: a/b\n---\nBody --- x\n---\n"
    assert out[2] == "---\nconfidence: 0.9\ntopic: a/b\nupdated: 2024-05-05\n---\nno front matter" and out[3].endswith("---\n")
    assert out[4] == "---\na: 1\nconfidence: 0.9\ntopic: a/b\nupdated: 2024-05-05\n---\nb"
