"""Upkeep of pages, sections and sessions: pieces of bounded size, moves between topics, trees, renames, routing of known tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmill.functions import text as X

#: Fixed value: bytes of a section above which it is cut.
SECTION_BYTES = 1024 * 1024
#: Rows of a batch that a task has in Python at a time.
SLICE = 64
TITLE_CHARS = 120


def pieces(heading_path: str | None, markdown: str | None, most: int) -> list[tuple[str | None, str]]:
    """A section as it is if it fits, else its paragraphs packed in order, each piece up to ``most`` bytes of text.

    A paragraph that is longer by itself is a piece by itself, so nothing is lost; pieces from the second on say which part they are.
    """
    markdown = markdown or ""
    if len(markdown.encode()) <= most:
        return [(heading_path, markdown)]
    groups: list[list[str]] = [[]]
    size = 0
    for paragraph in re.split(r"\n\n+", markdown):
        n = len(paragraph.encode())
        if groups[-1] and size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(paragraph)
        size += n
    return [(heading_path if not i else f"{heading_path or ''} (part {i + 1})", "\n\n".join(g)) for i, g in enumerate(groups)]


def enforce_size(sections: DataFrame, most: int = SECTION_BYTES) -> DataFrame:
    """``sections`` (heading_path, markdown, ...) cut at paragraphs: one row a piece, with its ``piece`` number from 0."""

    rest = [c for c in sections.columns if c not in ("heading_path", "markdown")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = [pieces(p, t, most) for p, t in zip(batch.column("heading_path").to_pylist(), batch.column("markdown").to_pylist(), strict=True)]
                of = pa.array([i for i, rows in enumerate(found) for _ in rows], type=pa.int64())
                piece = pa.array([i for rows in found for i in range(len(rows))], type=pa.int32())
                texts = [pa.array([r[k] for rows in found for r in rows], type=pa.string()) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in rest), piece, *texts], names=[*rest, "piece", "heading_path", "markdown"])

    fits = F.octet_length(F.coalesce("markdown", F.lit(""))) <= most  # only what is too long leaves the JVM's expressions
    whole = sections.where(fits).select(*rest, F.lit(0).alias("piece"), "heading_path", F.coalesce("markdown", F.lit("")).alias("markdown"))
    kinds = dict(sections.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "piece int, heading_path string, markdown string"])
    return whole.unionByName(sections.where(~fits).select(*rest, "heading_path", "markdown").mapInArrow(cut, ddl))


def retopic(pages: DataFrame, moves: DataFrame, today: Column) -> DataFrame:
    """``path, outcome, new_path, topic, topic_history, last_reviewed`` of moves (path, topic) of pages (path, topic, topic_history).

    A page goes to ``wiki/<topic>/<file>``, and its old topic to the end of its history unless it stands there. Outcomes: ``moved``,
    ``invalid topic``, ``invalid path`` (no markdown page), ``missing``, ``same topic``; only a moved page has new values. Of several moves of a page
    the one with the smallest topic counts.
    """
    wanted = moves.groupBy("path").agg(F.min(F.trim("topic")).alias("to"))
    rows = wanted.join(pages.select("path", F.trim("topic").alias("was"), F.coalesce("topic_history", F.array().cast("array<string>")).alias("history"), F.lit(True).alias("there")), "path", "left")
    outcome = F.when(~F.coalesce(X.is_topic(F.col("to")), F.lit(False)), "invalid topic").when(~F.col("path").endswith(".md"), "invalid path").when(F.col("there").isNull(), "missing").when(F.col("was") == F.col("to"), "same topic").otherwise("moved")
    old = F.when(F.length("was") > 0, F.col("was"))
    history = F.when(old.isNotNull() & ~F.coalesce(F.try_element_at("history", F.lit(-1)) == old, F.lit(False)), F.array_append("history", old)).otherwise(F.col("history"))
    moved = F.col("outcome") == "moved"
    new = F.concat(F.lit("wiki/"), F.col("to"), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    rows = rows.withColumn("outcome", outcome)
    return rows.select("path", "outcome", F.when(moved, new).alias("new_path"), F.when(moved, F.col("to")).alias("topic"), F.when(moved, history).alias("topic_history"), F.when(moved, today).alias("last_reviewed"))


def topic_tree(pages: DataFrame) -> DataFrame:
    """``path, name, depth, pages, own``: folders of the topic view with the pages below and right in them; pages without a topic are ``Untagged``."""
    parts = F.split("topic", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.get(parts, n - 1).alias("name"), (n - 1).alias("depth"), (n == F.size(parts)).cast("int").alias("own")))
    none = F.array(F.struct(F.lit("untagged").alias("path"), F.lit("Untagged").alias("name"), F.lit(0).alias("depth"), F.lit(1).alias("own")))
    rows = pages.select(F.explode(F.when(F.length("topic") > 0, prefixes).otherwise(none)).alias("n")).select("n.*")
    return rows.groupBy("path", "name", "depth").agg(F.count("*").alias("pages"), F.sum("own").alias("own"))


def type_tree(pages: DataFrame) -> DataFrame:
    """``path, name, pages`` of the type view: one folder a type, ``Other`` for pages without."""
    key = F.when(F.length("type") > 0, F.col("type")).otherwise("other")
    return pages.groupBy(key.alias("key")).agg(F.count("*").alias("pages")).select(F.concat(F.lit("view:type:"), "key").alias("path"), F.when(F.col("key") == "other", "Other").otherwise(F.col("key")).alias("name"), "pages")


def rename(sessions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``sessions`` (owner, session, title, updated_at) after renames (owner, session, title; null: a touch).

    Titles are trimmed and cut to 120 characters; a blank one, and the legacy session (an empty id), change nothing. Of several
    changes of a session the smallest title counts, a touch only where there is no other.
    """
    clean = F.left(F.trim("title"), F.lit(TITLE_CHARS))
    new = changes.where("session <> ''").select("owner", "session", clean.alias("to"), F.col("title").isNull().alias("touch")).where(F.col("touch") | (F.length("to") > 0))
    new = new.groupBy("owner", "session").agg(F.min("to").alias("to"), F.lit(True).alias("hit"))
    rows = sessions.join(new, ["owner", "session"], "left")
    return rows.select("owner", "session", F.coalesce("to", "title").alias("title"), F.when(F.col("hit"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def routed(frames: DataFrame, key: str, at: str, tie: str, opening: Column, terminal: Column) -> DataFrame:
    """Frames of tasks that are known when they come: after the frame that opened the task, up to its terminal one; all others are dropped.

    A task that is opened again after its end starts anew.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct(at, tie)
    rows = frames.withColumn("o_", F.max(F.when(opening, order)).over(before)).withColumn("t_", F.max(F.when(terminal, order)).over(before))
    known = F.col("o_").isNotNull() & (F.col("t_").isNull() | (F.col("t_") < F.col("o_")))
    return rows.where(opening | known).drop("o_", "t_")
