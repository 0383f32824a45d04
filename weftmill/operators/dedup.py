"""Content dedup: hashes and canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(rows: DataFrame, key: str = "doc_id", text: str = "plain") -> DataFrame:
    """``duplicate`` and ``existing_source`` of each row: the smallest key of equal content is canonical. A null text is empty.

    Texts are hashed once: keys and hashes alone are rebalanced, and the aggregate and the join read that one exchange. The
    hash is never null to the optimiser, which would otherwise hash again to filter nulls. The first writer comes from an
    aggregate with a map-side part, so content that very many rows share costs one row a task; the join back is an
    equi-join that adaptive execution can split where it is skewed.
    """
    content = F.coalesce(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(""))
    hashed = rows.select(key, content.alias("content_hash")).hint("rebalance")
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("existing"))
    later = F.col("existing") < F.col(key)
    return hashed.join(first, "content_hash").select(key, later.alias("duplicate"), F.when(later, F.col("existing")).alias("existing_source"))


def new_content(rows: DataFrame, manifest: DataFrame, text: str = "content") -> DataFrame:
    """Rows whose content hash a manifest doesn't have yet (a parse cache)."""
    return rows.withColumn("content_hash", F.sha2(text, 256)).join(manifest.select("content_hash"), "content_hash", "left_anti")
