"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets one temporary folder; a cluster
gets an error, since no machine's own folder is shared.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _FALLBACK[app] = _FALLBACK.get(app) or f"file://{tempfile.mkdtemp(prefix='weftmill-tables-')}"
    return f"{root.rstrip('/')}/weftmill/{uuid.uuid4().hex}-{tag}"


def kept(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` written and read back: it is computed once, and a lost executor costs tasks, not the lineage."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
