"""Upserts, merges and deletes as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_union(lists: list[DataFrame], by: str, key: str, rank: str) -> DataFrame:
    """Distinct union of ranked lists: the first occurrence of each key stays; ``by, key, position``."""
    every = None
    for i, rows in enumerate(lists):
        part = rows.select(by, key, rank).withColumn("list", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(by, key).agg(F.min(F.struct("list", rank)).alias("first"))
    return first.select(by, key, (F.row_number().over(Window.partitionBy(by).orderBy("first")) - 1).alias("position"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a stated order."""
    return keep_first(rows, keys, [F.desc(c) for c in order])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], defaults: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of the same key; columns in ``keep`` hold on to the old value, else the default."""
    defaults = defaults or {}
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    rows = a.join(b, on, "full_outer")
    there = F.coalesce(*[F.col(f"b.{k}").isNotNull() for k in keys[:1]])

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
        fresh = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in keep:
            return F.coalesce(F.col(f"a.{c}"), fresh, defaults.get(c, F.lit(None)))
        return F.when(there, F.coalesce(fresh, defaults.get(c, F.lit(None)))).otherwise(F.col(f"a.{c}"))

    return rows.select(*[value(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is new are added (the first of each); old ones stay as they are."""
    return old.unionByName(keep_first(new, keys, order).join(old.select(*keys), keys, "left_anti").select(old.columns))


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial updates: null leaves a column as it is."""
    some = [c for c in changes.columns if c != key]
    rows = old.join(changes.select(key, *[F.col(c).alias(f"new_{c}") for c in some]), key, "left")
    return rows.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in some else F.col(c) for c in old.columns])


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those whose key is listed; for a cascade, apply it to each dependent table."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def merge_sources(lists: Column) -> Column:
    """Union of source lists: one for each of path, wiki path or title; sources with none of them all stay."""
    ident = lambda s: F.coalesce(s["path"], s["wikiPath"], s["title"])
    return F.aggregate(F.flatten(lists), F.slice(F.flatten(lists), 1, 0), lambda a, s: F.when(ident(s).isNotNull() & F.exists(a, lambda x: ident(x) == ident(s)), a).otherwise(F.array_append(a, s)))
