"""Merging refined sections into documents: global chunk numbers, references to them, and everything deduplicated.

Rows carry ``doc, pos`` (the section's place in its document) and, where a section has several, ``at`` (their place in the section, from 0
without gaps). A chunk's number is its section's offset plus its place: sections are counted, the counts are added up in order within
each document, and rows get their offset by a join, so no document's chunks meet in one task, only its sections' counts
do. Every reference ``(doc, pos, local id)`` is mapped the same way. Whatever is deduplicated keeps its first occurrence by
``(pos, at)``, from an aggregate with a map-side part.

Null or empty names, relations without ends and blank keywords are dropped; a section without chunks counts zero; a document without a verdict
on quality is complete with confidence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(chunks: DataFrame) -> DataFrame:
    """``doc, pos, before``: chunks in the earlier sections of a document."""
    counts = chunks.groupBy("doc", "pos").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("doc", "pos", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def renumbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``new_id``, ``c1`` to ``cn`` through each document."""
    return chunks.join(offsets(chunks), ["doc", "pos"]).withColumn("new_id", F.concat(F.lit("c"), F.col("before") + F.col("at") + 1)).drop("before")


def remapped(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """``references`` (doc, pos, id, ...) with the ``new_id`` of the chunk they name in their section; those that name none are dropped."""
    return references.join(renumbered(chunks).select("doc", "pos", "id", "new_id"), ["doc", "pos", "id"])


def first_of(rows: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """The first row of each ``(doc, key)`` by ``(pos, at)``; rows with an empty key are dropped."""
    keyed = rows.withColumn("key_", key).where(F.length("key_") > 0)
    first = keyed.groupBy("doc", "key_").agg(F.min_by(F.struct("pos", "at", *columns), F.struct("pos", "at")).alias("r"))
    return first.select("doc", "r.*")


def entities(rows: DataFrame) -> DataFrame:
    """One entity for each name in any case; the first spelling, type and description stay."""
    return first_of(rows, F.lower("name"), ["name", "type", "description"])


def relations(rows: DataFrame) -> DataFrame:
    """One relation for each (source, target, keywords)."""
    whole = rows.where("source is not null and target is not null")
    return first_of(whole, F.concat_ws("|", "source", "target", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ",")), ["source", "target", "keywords", "description"])


def keywords(rows: DataFrame) -> DataFrame:
    return first_of(rows, F.col("keyword"), ["keyword"])


def section_summaries(rows: DataFrame) -> DataFrame:
    """``doc, title, summary`` by title in any case: the first summary that isn't blank, else the first."""
    blank = F.length(F.trim(F.coalesce("summary", F.lit("")))) == 0
    keyed = rows.withColumn("key_", F.lower(F.trim("title"))).where("key_ is not null")
    first = keyed.groupBy("doc", "key_").agg(F.min_by(F.struct("pos", "at", "title", "summary"), F.struct(blank.alias("blank"), F.col("pos"), F.col("at"))).alias("r"), F.min(F.struct("pos", "at")).alias("seen"))
    return first.select("doc", "seen.pos", "seen.at", "r.title", "r.summary")


def documents(sections: DataFrame) -> DataFrame:
    """``doc, markdown, summary, complete, confidence, review`` of sections (doc, pos, markdown, summary, complete, confidence, action).

    All must be complete, one that wants a review is enough, confidence is the mean of the sections that have a verdict.
    """
    text = F.trim(F.coalesce("markdown", F.lit("")))
    some = F.when(F.length(F.trim("summary")) > 0, F.col("summary"))
    judged = F.col("confidence").isNotNull()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text != "", F.struct("pos", text.alias("text"))))), lambda x: x["text"]), "\n\n")  # one document's own text
    return sections.groupBy("doc").agg(
        joined.alias("markdown"), F.coalesce(F.min_by(some, F.when(some.isNotNull(), F.col("pos"))), F.lit("")).alias("summary"), F.coalesce(F.bool_and(F.when(judged, F.col("complete"))), F.lit(True)).alias("complete"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.bool_or(F.when(judged, F.col("action") == "review_required")), F.lit(False)).alias("review"),
    )
