"""The cursor stream over restarts, and file sinks over failures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from weftmill.sources import cursor, pagefiles


def _collection(base):
    """A collection of pages by cursor, kept in a file, so that it can grow between runs; calls are noted."""

    def fetch(resource, cursor, size):
        with open(f"{base}/items.json") as f:
            items = json.load(f)
        at = int(cursor or 0)
        with open(f"{base}/calls", "a") as f:
            f.write(f"{at}\n")
        page = items[at : at + size]
        return page, str(at + len(page)), at + len(page) < len(items)

    return fetch


def _run(spark, base):
    stream = spark.readStream.format("cards").options(resource="cards", size="7", pages="2").load()
    q = stream.writeStream.format("parquet").option("path", f"file://{base}/out").option("checkpointLocation", f"file://{base}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(json.loads(r.item)["n"] for r in spark.read.parquet(f"file://{base}/out").collect())


def test_cursor_stream_goes_on_where_it_stopped(spark, tmp_path):
    base = str(tmp_path)
    fetch = _collection(base)
    cursor.register(spark, fetch, "cards")
    reader = cursor.CursorReader(fetch, {"size": "7", "pages": "2"})

    def grow(n):
        with open(f"{base}/items.json", "w") as f:
            json.dump([{"n": i} for i in range(n)], f)

    grow(0)
    rows, end = reader.read({"cursor": None})
    assert not list(rows) and end == {"cursor": None}
    grow(40)
    rows, end = reader.read({"cursor": "14"})
    rows = list(rows)
    assert end == {"cursor": "28"} and rows == list(reader.readBetweenOffsets({"cursor": "14"}, end)) and len(rows) == 14
    assert _run(spark, base) == list(range(40))
    before = len(open(f"{base}/calls").read().split())
    grow(55)
    assert _run(spark, base) == list(range(55))
    again = [int(x) for x in open(f"{base}/calls").read().split()[before:]]
    assert min(again) >= 28  # of what was committed at most the last batch is fetched again
    assert _run(spark, base) == list(range(55))
    grow(20)
    with pytest.raises(ValueError, match="no longer reaches"):
        list(reader.readBetweenOffsets({"cursor": "28"}, {"cursor": "42"}))


def _tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


def test_pages_and_images_become_files(spark, tmp_path):
    root = f"{tmp_path}/site"
    pages = spark.createDataFrame([("concept", "A/B", "My Page", "Body."), ("event", None, "Other", "é"), ("event", "", "Third", "")], "type string, topic string, title string, body string")
    pagefiles.write_pages(pages, f"file://{root}")
    assert _tree(root) == ["wiki/a/b/my-page.md", "wiki/event/other.md", "wiki/event/third.md"]
    assert open(f"{root}/wiki/event/other.md", encoding="utf-8").read().endswith("é") and "title: Other" in open(f"{root}/wiki/event/other.md", encoding="utf-8").read()
    images = spark.createDataFrame([("a.PNG", bytearray(b"1")), ("b.png", bytearray(b"1")), ("c.gif", bytearray(b"2")), ("d.gif", None)], "name string, content binary")
    pagefiles.write_files(pagefiles.media(images), f"file://{root}")
    assert sum(x.startswith("media/") for x in _tree(root)) == 2
    with pytest.raises(FileExistsError):
        pagefiles.write_pages(pages, f"file://{root}")
    pagefiles.write_pages(pages.withColumn("body", F.lit("new")), f"file://{root}", overwrite=True)
    assert open(f"{root}/wiki/event/third.md").read().endswith("new")
    assert not os.path.exists(f"{root}/.staging") or not os.listdir(f"{root}/.staging")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/site"
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("p/"), "id").alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        pagefiles.write_files(rows, f"file://{root}")
    assert _tree(root) == []
    for path in ("../out", "/etc/x", "a/../../b", "a\nb"):
        with pytest.raises(Exception, match="path"):
            pagefiles.write_files(spark.createDataFrame([(path, "x"), ("fine", "x")], "path string, content string"), f"file://{root}")
    assert _tree(root) == []
    pagefiles.write_files(rows.where("id <> 33"), f"file://{root}")
    assert len(_tree(root)) == 39
