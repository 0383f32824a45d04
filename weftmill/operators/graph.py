"""Property-graph tables: nodes, edges, scope filters, export, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmill.functions.text import fold_key


def topic_filter(column: Column, topic: str | None = None, topics: list[str] | None = None) -> Column:
    """A list of topics wins over one topic; neither filters nothing."""
    if topics:
        return column.isin(*topics)
    return column == topic if topic else F.lit(True)


def relation_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations joined to entities by folded name on both ends; one edge a pair, the last (doc, pos) wins."""
    e = entities.select("name").withColumn("key", fold_key(F.col("name"))).groupBy("key").agg(F.min("name").alias("name"))
    rows = relations.withColumn("a", fold_key(F.col("source"))).withColumn("b", fold_key(F.col("target")))
    rows = rows.join(e.select(F.col("key").alias("a"), F.col("name").alias("src")), "a").join(e.select(F.col("key").alias("b"), F.col("name").alias("dst")), "b")
    return rows.groupBy("src", "dst").agg(F.max_by("keyword", F.struct("doc", "pos")).alias("keyword"))


def export(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One node table ``(id, label)`` and one edge table ``(src, dst, type)``."""
    n = e = None
    for label, df in nodes.items():
        part = df.select(F.col("id").cast("string"), F.lit(label).alias("label"))
        n = part if n is None else n.unionByName(part)
    for kind, df in edges.items():
        part = df.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(kind).alias("type"))
        e = part if e is None else e.unionByName(part)
    return n.distinct(), e.distinct()


def classify_change(old: DataFrame, new: DataFrame, key: str = "id", content: str = "hash") -> DataFrame:
    """``key, change``: unchanged, changed, added or removed chunks of an overwritten document."""
    a, b = old.select(key, F.col(content).alias("was")), new.select(key, F.col(content).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def prunable_edges(edges: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Edges neither of whose ends is mentioned any more."""
    m = mentioned.select("entity").distinct()
    return edges.join(m.withColumnRenamed("entity", "src"), "src", "left_anti").join(m.withColumnRenamed("entity", "dst"), "dst", "left_anti")


def orphans(entities: DataFrame, edges: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Entities without an edge and without a mention."""
    used = edges.select(F.col("src").alias("entity")).unionByName(edges.select(F.col("dst").alias("entity"))).unionByName(mentioned.select("entity")).distinct()
    return entities.join(used, "entity", "left_anti")
