"""Markdown into blocks, sections and chunks, as window functions over lines of a document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(#{1,6})\s+(.*)$"


def blocks(docs: DataFrame, key: str = "doc_id", md: str = "md") -> DataFrame:
    """``key, pos, kind, level, text``: headings and paragraphs (runs of non-blank lines) in order.

    The running groups are windows over one document, which is one page's text, never over the corpus.
    """
    lines = docs.select(key, F.posexplode(F.split(md, r"\r?\n")).alias("line", "raw"))
    order = Window.partitionBy(key).orderBy("line")
    lines = lines.withColumn("head", F.col("raw").rlike(HEADING)).withColumn("blank", F.trim("raw") == "")
    before = F.coalesce(F.lag(F.col("blank") | F.col("head")).over(order), F.lit(True))
    lines = lines.withColumn("grp", F.sum(F.when(~F.col("blank") & (F.col("head") | before), 1).otherwise(0)).over(order)).where(~F.col("blank"))
    grouped = lines.groupBy(key, "grp").agg(F.bool_or("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    level = F.when(F.col("head"), F.length(F.regexp_extract("raw", HEADING, 1))).otherwise(0)
    return grouped.select(key, (F.col("grp") - 1).cast("int").alias("pos"), F.when(F.col("head"), "heading").otherwise("paragraph").alias("kind"), level.alias("level"), F.when(F.col("head"), F.trim(F.regexp_extract("raw", HEADING, 2))).otherwise(F.trim("raw")).alias("text"))


def heading_path(key: str = "doc_id") -> Column:
    """The headings that a block stands under, joined by `` / ``.

    For each level, the last heading of that level so far counts unless a heading of a smaller level came after it.
    """
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at, name = [], []
    for k in range(1, 7):
        mine = F.when(F.col("level") == k, F.struct("pos", "text"))
        at.append(F.coalesce(F.last(mine, ignorenulls=True).over(order)["pos"], F.lit(-1)))
        name.append(F.last(mine, ignorenulls=True).over(order)["text"])
    alive = []
    for k in range(6):
        above = F.greatest(*at[:k], F.lit(-1)) if k else F.lit(-1)
        alive.append(F.when((at[k] >= 0) & (at[k] > above), name[k]))
    return F.concat_ws(" / ", *alive)


def chunks(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, chunk_id, heading_path, text``: each paragraph with its path, numbered c1, c2, ..."""
    rows = found.withColumn("heading_path", heading_path(key)).where("kind = 'paragraph'")
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.select(key, F.concat(F.lit("c"), number).alias("chunk_id"), "heading_path", "text")


def sections(found: DataFrame, level: int = 1, key: str = "doc_id") -> DataFrame:
    """``key, section, title, n_blocks, bytes``: split at headings of a level; section 0 is what stands before the first."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = found.withColumn("section", F.sum(F.when(F.col("level") == level, 1).otherwise(0)).over(order))
    return rows.groupBy(key, "section").agg(F.max(F.when(F.col("level") == level, F.col("text"))).alias("title"), F.count("*").alias("n_blocks"), F.sum(F.octet_length("text")).alias("bytes"))


def split_level(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, split_at``: level one, or two where level one gives a single section at most."""
    n = found.groupBy(key).agg(F.count_if(F.col("level") == 1).alias("h1"))
    return n.select(key, F.when(F.col("h1") > 1, 1).otherwise(2).alias("split_at"))


def greedy_groups(sizes: Column, limit: int) -> Column:
    """The group of each size when consecutive items are packed greedily up to ``limit`` (a fold over one document)."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("grp"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["used"] > 0) & (acc["used"] + x > limit)
        grp = F.when(fresh, acc["grp"] + 1).otherwise(acc["grp"])
        return F.struct(F.when(fresh, x).otherwise(acc["used"] + x).cast("long").alias("used"), grp.alias("grp"), F.array_append(acc["out"], grp).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def batches(rows: DataFrame, size: int, order: str, key: str | None = None) -> DataFrame:
    """Fixed-size batches in order within a key."""
    w = Window.partitionBy(key).orderBy(order) if key else Window.orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def apply_patches(found: DataFrame, patches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Patches against the original block grid; a wrong kind or a position out of range is ignored.

    ``patches`` has ``key, seq, op, index, text, level``; ops: ``set_heading``, ``set_text``, ``set_level``,
    ``delete``, ``insert_after``. Each document is folded on its own, in ``seq`` order.
    """
    kind = dict(found.dtypes)[key]

    def fold(grid: list[dict], changes: list[dict]) -> list[dict]:
        kinds = [b["kind"] for b in grid]
        rows: list[dict | None] = list(grid)
        after: dict[int, list[dict]] = {}
        for c in changes:
            i = c["index"]
            if i is None or not 0 <= i < len(rows):
                continue
            row, op = rows[i], c["op"]
            if op == "insert_after":
                after.setdefault(i, []).append({"kind": "paragraph", "level": 0, "text": c["text"]})
            elif row is None:
                continue
            elif op == "delete":
                rows[i] = None
            elif op == "set_text" and kinds[i] == "paragraph" or op == "set_heading" and kinds[i] == "heading":
                row["text"] = c["text"]
            elif op == "set_level" and kinds[i] == "heading" and c["level"] is not None:
                row["level"] = min(6, max(1, int(c["level"])))
        return [r for i, row in enumerate(rows) for r in ([row] if row else []) + after.get(i, [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                out = [fold(g, c or []) for g, c in zip(batch.column("grid").to_pylist(), batch.column("changes").to_pylist(), strict=True)]
                every = [r for rows in out for r in rows]
                of = pa.array([i for i, rows in enumerate(out) for _ in rows], type=pa.int64())
                pos = pa.array([i for rows in out for i in range(len(rows))], type=pa.int32())
                columns = [pa.array([r[c] for r in every], type=t) for c, t in (("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("key_").take(of), pos, *columns], names=[key, "pos", "kind", "level", "text"])

    listed = lambda rows, name, *fields: rows.groupBy(F.col(key).alias("key_")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))  # noqa: E731  one document's own
    grid, changes = listed(found, "grid", "pos", "kind", "level", "text"), listed(patches, "changes", "seq", "op", "index", "text", "level")
    both = grid.join(changes, grid["key_"].eqNullSafe(changes["key_"]), "left").select(grid["key_"], "grid", "changes")
    return both.mapInArrow(run, f"{key} {kind}, pos int, kind string, level int, text string")


def align_headings(source: DataFrame, refined: DataFrame, key: str = "doc_id") -> DataFrame:
    """Levels of refined headings from the source: by position if the text is equal, else by text (the last one wins)."""
    by_text = source.groupBy(key, "text").agg(F.max_by("level", "pos").alias("text_level"))
    at = source.select(key, "pos", F.col("text").alias("source_text"), F.col("level").alias("pos_level"))
    rows = refined.join(at, [key, "pos"], "left").join(by_text, [key, "text"], "left")
    level = F.when(F.col("source_text") == F.col("text"), F.col("pos_level")).otherwise(F.coalesce("text_level", "level"))
    return rows.select(key, "pos", "text", level.alias("level"))


def mark_descriptions(docs: DataFrame, key: str = "doc_id", md: str = "md", opening: str = "<!-- image-description -->", closing: str = "<!-- /image-description -->") -> DataFrame:
    """Lines between the two markers in italics; the markers go (a fold over one page's lines)."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        is_open, is_close = t == opening, t == closing
        shown = F.when(acc["inside"] & (t != ""), F.concat(F.lit("*"), t, F.lit("*"))).otherwise(line)
        out = F.when(is_open | is_close, acc["out"]).otherwise(F.array_append(acc["out"], shown))
        return F.struct(F.when(is_open, True).when(is_close, False).otherwise(acc["inside"]).alias("inside"), out.alias("out"))

    return docs.withColumn(md, F.array_join(F.aggregate(F.split(md, "\n"), start, step, lambda a: a["out"]), "\n"))

