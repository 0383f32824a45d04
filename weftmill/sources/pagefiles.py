"""Pages and images as files: a data source writer that stages a task's files, and a publication of all or nothing.

``write_files(rows, root)`` takes ``path, content`` (binary or text) and puts one file a row below ``root``, a folder that driver and
executors share (``/...`` or ``file:///...``). Tasks write into their own staging folder and hand Spark the name of a
list of what they wrote; only when every task has committed, the job's mark appears, and a second Spark job moves the
files to their places, each by one rename. If a task fails, the staging folder goes and nothing was to be seen; a retried task
has a folder of its own, and a publication that was cut off is repeated by ``publish``. Renames are made by tasks, so the driver
holds one line for each task.

``media(rows)`` gives images a path by their content, so equal ones are one file. A null path or content is left out; paths that
leave the root raise; of rows with one path one stays whole; existing files are replaced only with ``overwrite``.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from weftmill.functions import text as X
from weftmill.session import ship_package

_STAGING = ".staging"


def local(root: str) -> str:
    return root.removeprefix("file://")


def inside(root: str, path: str) -> str:
    """The place of ``path`` below ``root``; raises if it leaves it."""
    place = os.path.normpath(os.path.join(root, path))
    if os.path.isabs(path) or not place.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"path leaves the root: {path}")
    return place


@dataclass
class Listed(WriterCommitMessage):
    listing: str


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageWriter(dict(self.options))


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.job = options["job"]

    def write(self, rows: Iterator) -> Listed:
        context = TaskContext.get()
        own = os.path.join(self.job, f"task-{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(own)
        with open(os.path.join(own, "listing"), "w", encoding="utf-8") as listing:
            for n, row in enumerate(rows):
                inside(self.job, row.path)
                if "\n" in row.path:
                    raise ValueError(f"line break in a path: {row.path!r}")
                with open(os.path.join(own, str(n)), "wb") as f:
                    f.write(bytes(row.content))
                listing.write(f"{n}\t{row.path}\n")
        return Listed(os.path.join(own, "listing"))

    def commit(self, messages: list) -> None:
        mark = os.path.join(self.job, "committed")
        with open(mark + ".tmp", "w", encoding="utf-8") as f:
            f.write("\n".join(m.listing for m in messages if m))
        os.rename(mark + ".tmp", mark)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


def publish(spark: SparkSession, root: str, job: str, overwrite: bool = False) -> None:
    """Move the files of a committed job to their places; can be repeated after a failure."""
    with open(os.path.join(job, "committed"), encoding="utf-8") as f:
        listings = [x for x in f.read().split("\n") if x]
    base = local(root)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for listing in batch.column("listing").to_pylist():
                with open(listing, encoding="utf-8") as f:
                    for line in f:
                        n, _, path = line.rstrip("\n").partition("\t")
                        staged, place = os.path.join(os.path.dirname(listing), n), inside(base, path)
                        if os.path.exists(staged):
                            os.makedirs(os.path.dirname(place), exist_ok=True)
                            os.replace(staged, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    names = spark.createDataFrame([(x,) for x in listings], "listing string")
    if not overwrite:
        there = names.mapInArrow(_taken(base), "path string").limit(1).collect()
        if there:
            shutil.rmtree(job, ignore_errors=True)
            raise FileExistsError(f"{there[0].path} exists below {root}")
    names.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    shutil.rmtree(job, ignore_errors=True)


def _taken(base: str):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for listing in batch.column("listing").to_pylist():
                with open(listing, encoding="utf-8") as f:
                    found += [p for p in (line.rstrip("\n").partition("\t")[2] for line in f) if os.path.exists(inside(base, p))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    return look


def write_files(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """One file a row of ``path, content`` below ``root``; nothing if anything fails before publication."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(PageFiles)
    job = os.path.join(local(root), _STAGING, uuid.uuid4().hex)
    clean = rows.where("path is not null and content is not null").select("path", F.col("content").cast("binary").alias("content")).dropDuplicates(["path"])
    os.makedirs(job)
    try:
        clean.write.format("pagefiles").option("job", job).mode("append").save()
    except Exception:
        shutil.rmtree(job, ignore_errors=True)
        raise
    publish(spark, root, job, overwrite)


def page_path(title: Column, topic: Column, kind: Column) -> Column:
    """``wiki/<topic, else type>/<slug>.md``."""
    folder = F.when(F.length(F.trim(topic)) > 0, X.normalize_topic(topic))
    return F.concat(F.lit("wiki/"), F.coalesce(folder, kind), F.lit("/"), X.slugify(title), F.lit(".md"))


def media(images: DataFrame) -> DataFrame:
    """``path, content, name`` of images (name, content): the path is the digest of the content and the name's ending."""
    sha = F.sha2(F.col("content"), 256)
    return images.select(F.concat(F.lit("media/"), F.left(sha, F.lit(2)), F.lit("/"), sha, F.lower(F.regexp_extract("name", r"\.[A-Za-z0-9]+$", 0))).alias("path"), "content", "name")


def write_pages(pages: DataFrame, root: str, overwrite: bool = False) -> None:
    """Pages (type, topic, title, body) as markdown files with front matter."""
    keys, values = F.array(F.lit("type"), F.lit("title"), F.lit("topic")), F.array("type", "title", F.coalesce("topic", F.lit("")))
    write_files(pages.select(page_path(F.col("title"), F.col("topic"), F.col("type")).alias("path"), X.render_frontmatter(keys, values, F.col("body")).alias("content")), root, overwrite)
