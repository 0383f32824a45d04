"""Entity search by a stored inverted index over folded names and aliases.

The index is a table ``term, entity, weight``: a term's BM25 weight in the entity's name plus that in its aliases, each field with
its own lengths and document frequencies. A query's score for an entity is the sum of the weights of the terms they
share, so a search is one equi-join on terms and one sum, and what leaves the index is only what some query asks for. The table is
written in ranges of terms, sorted, so that Parquet's statistics skip the row groups that hold no term asked for.

A null or empty name, alias or query has no terms; a term that a query repeats counts once, one that a name repeats by its
frequency; equal names are one entity with the aliases of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmill.functions.text import fold, tokens
from weftmill.operators import retrieval as S

K1, B = 1.2, 0.75
NAME, ALIAS = "name", "alias"


def merged(entities: DataFrame) -> DataFrame:
    """``entity, aliases``, a row for each name."""
    alias = entities.where(F.col("entity").isNotNull()).select("entity", F.explode_outer("aliases").alias("alias"))
    return alias.groupBy("entity").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def build(entities: DataFrame, boost: dict[str, float] | None = None) -> DataFrame:
    """The postings ``term, entity, weight`` of ``entity, aliases``; ``boost`` weighs the fields ``name`` and ``alias``."""
    boost = {NAME: 1.0, ALIAS: 1.0} | (boost or {})

    def field(name: str, values: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(boost[name]).alias("boost"), F.flatten(F.transform(values, lambda v: tokens(fold(v)))).alias("terms"))

    rows = merged(entities).select("entity", F.explode(F.array(field(NAME, F.array("entity")), field(ALIAS, F.col("aliases")))).alias("f"))
    rows = rows.select("entity", "f.*").where(F.size("terms") > 0).withColumn("len", F.size("terms"))
    size = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))  # one row for each of two fields
    counted = rows.select("entity", "field", "boost", "len", F.explode("terms").alias("term")).groupBy("entity", "field", "boost", "len", "term").agg(F.count("*").alias("tf"))
    frequent = counted.groupBy("field", "term").agg(F.count("*").alias("df"))
    weighed = counted.join(frequent, ["field", "term"]).join(size, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("boost") * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return weighed.groupBy("term", "entity").agg(F.sum(weight).alias("weight"))


def write(postings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store the postings in ranges of terms."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "entity").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, entity string, weight double").parquet(path)


def match(queries: DataFrame, postings: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """``qid, entity, score, rank``: the ``k`` best entities of each query (qid, text); ties go to the smaller name.

    Scores are rounded to ``digits`` before they are ranked, so that the order of a sum doesn't decide between equals.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(tokens(fold(F.col("text"))))).alias("term"))
    scored = asked.join(postings, "term").groupBy("qid", "entity").agg(F.round(F.sum("weight"), digits).alias("score"))
    return S.top(scored, k, ident="entity")


def mentions(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity, id``: chunks whose folded text holds the folded name or an alias of an entity."""
    named = merged(entities).select("entity", F.transform(F.array_append("aliases", F.col("entity")), fold).alias("aliases"))
    return S.mentions(chunks.select("id", fold(F.col("text")).alias("text")), named)


def search(queries: DataFrame, postings: DataFrame, mention: DataFrame, relations: DataFrame, k: int, entities: int = 5) -> DataFrame:
    """``qid, id, score, rank, entity, neighbours``: chunks that mention a query's best ``entities``, best first."""
    return S.graph_topk(match(queries, postings, entities).select("qid", "entity", "score"), mention, relations, k)
