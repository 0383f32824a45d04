"""A training corpus from raw documents, in stages that each take what the one before kept.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``. ``run`` writes
each stage's result as Parquet in the shared folder and reads it again. The result has no SQL twin: the classifier and
the tokenizer are beyond SQL; ``tests/llm/test_pipeline.py`` holds each stage against a brute-force version instead.
What the stages write on the way is deleted as soon as the next one has been written; only the result stays.

Defined edge cases: an empty table gives an empty table at every stage; null texts are empty; very long texts are taken
whole; columns beyond those of ``documents`` pass through all stages but the last. Rows without an id pass the second
stage, each by itself; repeated rows are one row after it; see each operator for its ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmill.llm import decontam, packing, pii, simhash, toxicity
from weftmill.llm.common import materialize, scratch_tables
from weftmill.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    ship_package(spark)
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if benchmark windows cover a twentieth of their words or more."""
    return decontam.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship_package(spark)
    return pii.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, encoded and packed."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", redact_personal_data), ("packing", pack_windows)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed pieces."""
    docs = _table(spark, sf_dir, "documents")
    with scratch_tables(spark) as made:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
            made.drop(keep=docs._weftmill_path)
    return docs
