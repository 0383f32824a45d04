"""The search facade: expand, scope, search, rerank, enrich, count reads; and a planner with injected parts."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmill.functions.text import is_definitional
from weftmill.functions.udf import expand_terms
from weftmill.operators import entities as E
from weftmill.operators import retrieval as S
from weftmill.scratch import kept

BEST_ENTITIES = 5


def empty_hits(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")


@dataclass
class Corpus:
    """Tables a search works on: chunks (id, text, topic, section), vectors (id, vector), and optional graph tables."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    mappings: DataFrame | None = None


def retriever(name: str | None, picked: str | None = None, default: str = "hybrid") -> str:
    """An explicit choice beats the picker's, which beats the default."""
    for choice in (name, picked):
        if choice in ("vector", "bm25", "graph", "hybrid", "fused"):
            return choice
    return default


def search(queries: DataFrame, corpus: Corpus, k: int = 5, scope: str | None = None, how: str = "fused", enrich: bool = False, reranked: bool = False) -> DataFrame:
    """``qid, id, fused, score, source, rank`` for a batch of queries (qid, text[, vector]).

    A source whose table is absent gives no hits; the scope is applied before any ranking.
    """
    chunks = corpus.chunks.where(S.in_scope(F.col("topic"), scope)) if scope else corpus.chunks
    if corpus.mappings is not None:
        queries = expand_terms(queries, corpus.mappings, "text").drop("text").withColumnRenamed("expanded", "text")
    lists = []
    if how in ("vector", "hybrid", "fused") and corpus.vectors is not None and "vector" in queries.columns:
        vectors = corpus.vectors.join(chunks.select("id"), "id", "left_semi") if scope else corpus.vectors
        lists.append(S.vector_topk(queries.select("qid", "vector"), vectors, k).select("qid", "id", "score", "rank"))
    if how in ("bm25", "hybrid", "fused"):
        lists.append(S.bm25(queries.select("qid", "text"), chunks.select("id", "text"), k).select("qid", "id", "score", "rank"))
    if how in ("graph", "fused") and corpus.entities is not None and corpus.relations is not None:
        postings = E.build(corpus.entities)
        best = kept(E.match(queries.select("qid", "text"), postings, BEST_ENTITIES), "matched")
        known = corpus.entities.join(best.select("entity").distinct(), "entity", "left_semi")  # only what some query matched is looked for
        lists.append(S.graph_topk(best.select("qid", "entity", "score"), E.mentions(chunks, known), corpus.relations, k).select("qid", "id", "score", "rank"))
    hits = S.rrf(lists or [empty_hits(queries)], k)
    if reranked:
        hits = S.rerank(hits.select("qid", "id", "score", "rank"), chunks, queries.select("qid", "text"))
    return S.siblings(hits, corpus.chunks) if enrich else hits


def reads(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Read events of a search to append: each page once a query."""
    return hits.join(pages, "id").select("qid", "path").distinct()


@dataclass
class Answer:
    """What a batch of queries brings: results, the question each may refer to, the reads to note, and the sources that failed."""

    results: DataFrame
    references: DataFrame
    reads: DataFrame
    failed: list[str]


def knowledge_search(queries: DataFrame, corpus: Callable[[], Corpus], pages: Callable[[], DataFrame], pairs: Callable[[], DataFrame] | None = None, k: int = 5, scope: str | None = None, threshold: float = 0.9, how: str = "fused") -> Answer:
    """Semantic hits and keyword hits of wiki pages, in this order, and the stored question nearest to each query.

    ``results``: ``qid, position, kind, id, path, score``. Keyword hits are the ``k`` best pages (id, path, text, topic) of all, of which those
    outside the scope are then left out; semantic hits are scoped before they are ranked. ``references``: ``qid, id, score`` of
    the most similar pair (id, vector) at or above ``threshold``, by the queries' vectors. ``reads``: each page once a query. A source whose tables can't be
    read is named in ``failed`` and gives nothing; the others still answer.
    """
    spark, failed = queries.sparkSession, []

    def tried(name: str, make: Callable[[], DataFrame], ddl: str) -> DataFrame:
        try:
            rows = make()
            rows.schema  # noqa: B018  a missing table or column shows here
            return rows
        except AnalysisException as e:
            logging.getLogger(__name__).warning("%s failed: %s", name, e)
            failed.append(name)
            return spark.createDataFrame([], ddl)

    hits = "qid long, kind int, id long, score double, rank int"

    def semantic() -> DataFrame:
        return search(queries, corpus(), k, scope, how).select("qid", F.lit(0).alias("kind"), "id", F.col("fused").alias("score"), "rank")

    def keyword() -> DataFrame:
        found = pages()
        asked = queries.select("qid", "text")
        if (maps := corpus().mappings) is not None:
            asked = expand_terms(asked, maps, "text").drop("text").withColumnRenamed("expanded", "text")
        best = S.bm25(asked, found.select("id", "text"), k)
        if scope:
            best = best.join(found.where(S.in_scope(F.col("topic"), scope)).select("id"), "id", "left_semi")
        return best.select("qid", F.lit(1).alias("kind"), "id", "score", "rank")

    def near() -> DataFrame:
        found = S.vector_topk(queries.select("qid", "vector"), pairs().select("id", "vector"), 1)
        return found.where(F.col("score") >= threshold).select("qid", "id", "score")

    listed = tried("semantic", semantic, hits).unionByName(tried("keyword", keyword, hits))
    paths = tried("pages", lambda: pages().select("id", "path"), "id long, path string")
    w = Window.partitionBy("qid").orderBy("kind", "rank", "id")
    named = listed.join(paths, "id", "left").withColumn("position", F.row_number().over(w) - 1)
    results = named.select("qid", "position", F.when(F.col("kind") == 0, "semantic").otherwise("keyword").alias("kind"), "id", "path", "score")
    references = tried("questions", near, "qid long, id long, score double") if pairs and "vector" in queries.columns else spark.createDataFrame([], "qid long, id long, score double")
    return Answer(results, references, results.where("path is not null").select("qid", "path").distinct(), failed)


def read_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("path").agg(F.count("*").alias("read_count"))


@dataclass
class Planner:
    """How questions are answered: the parts that would be model calls are functions with deterministic defaults.

    ``split`` decomposes a question into parts, ``relevant`` says which hits count, ``fallback`` finds hits elsewhere.
    """

    split: Callable[[DataFrame], DataFrame] | None = None
    relevant: Callable[[DataFrame], DataFrame] | None = None
    fallback: Callable[[DataFrame], DataFrame] | None = None
    steps: list[str] = field(default_factory=list)

    def plan(self, queries: DataFrame) -> DataFrame:
        """``qid, text, plan``: too short a question is to be clarified unless it is definitional; `` and `` splits."""
        words = F.size(F.split(F.trim("text"), r"\s+"))
        plan = F.when(is_definitional(F.col("text")), "direct").when(words < 2, "clarify").when(F.col("text").contains(" and "), "decompose").otherwise("direct")
        return queries.withColumn("plan", plan)

    def answer(self, queries: DataFrame, corpus: Corpus, k: int = 5) -> DataFrame:
        """``qid, plan, hits``: sub-questions searched in one batch, their hits in order, the first of each id kept."""
        planned = self.plan(queries)
        if self.split:
            parts = self.split(planned)
        else:
            pieces = F.when(F.col("plan") == "decompose", F.split("text", " and ")).otherwise(F.array("text"))
            parts = planned.where("plan <> 'clarify'").select(F.col("qid").alias("parent"), F.posexplode(pieces).alias("part", "text"))
        parts = parts.withColumn("qid", F.struct("parent", "part"))
        hits = search(parts.select("qid", "text"), corpus, k, how="bm25").join(parts.select("qid", "parent", "part"), "qid")
        hits = self.relevant(hits) if self.relevant else hits
        if self.fallback:
            hits = hits.unionByName(self.fallback(parts.join(hits.select("qid"), "qid", "left_anti")), allowMissingColumns=True)
        first = hits.groupBy("parent", "id").agg(F.min(F.struct("part", "rank")).alias("seen"))
        listed = first.groupBy(F.col("parent").alias("qid")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seen", "id"))), lambda x: x["id"]), 1, k).alias("hits"))
        return planned.join(listed, "qid", "left").select("qid", "plan", F.coalesce("hits", F.array().cast("array<long>")).alias("hits"))
