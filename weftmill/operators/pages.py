"""Deleting pages: the pages that stay, and the folders that a delete leaves empty.

Every page counts once for each of its ancestor folders; the counts, and those of deleted pages, come from one aggregate with a
map-side part, so all emptied folders, nested ones too, fall out at once instead of walking up from each page.

A null path is no page; deleting what isn't there does nothing; the root folder always stays; equal paths are one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The folders above a page, outermost first, without the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def delete(pages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pages that stay, folders)``; folders: ``folder, pages`` (deleted below it), the emptied ones, to be removed."""
    drop = gone.where("path is not null").select("path").distinct()
    kept = pages.where("path is not null").join(drop, "path", "left_anti")
    marked = pages.where("path is not null").select("path").distinct().join(drop.withColumn("hit", F.lit(1)), "path", "left")
    inside = F.filter(ancestors(F.col("path")), lambda f: f != "")
    folders = marked.select(F.explode(F.when(F.size(F.split("path", "/")) > 1, inside).otherwise(F.array().cast("array<string>"))).alias("folder"), F.coalesce("hit", F.lit(0)).alias("hit"))
    counts = folders.groupBy("folder").agg(F.count("*").alias("n"), F.sum("hit").alias("pages"))
    return kept, counts.where("n = pages").select("folder", "pages")
