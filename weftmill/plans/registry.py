"""The registered queries: a callable of (spark, sf_dir) for each operator, and its SQL twin."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmill.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLANS = ("text", "rules", "chunks", "retrieval", "graph", "lifecycle", "board", "chat", "code", "streams", "relational", "facade", "entity", "ingest", "merging", "feedback", "upkeep")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(docs: DataFrame) -> DataFrame:
    """Documents as markdown: source and language as headings, each line its own paragraph."""
    return docs.withColumn("md", F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))))


NL = "chr(10)"
MD = f"('# ' || source || {NL} || {NL} || '## ' || lang || {NL} || {NL} || replace(text, {NL}, {NL} || {NL}))"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

for _plan in PLANS:
    if importlib.util.find_spec(f"weftmill.plans.{_plan}"):
        importlib.import_module(f"weftmill.plans.{_plan}")
