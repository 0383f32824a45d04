"""Queries over the entity index: long words of documents are the entities, benchmark items ask."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from weftmill.operators import entities as E
from weftmill.plans.registry import query, table
from weftmill.scratch import kept

_K, _BEST = 10, 3
#: Two words of six letters or more, each taken whole and never given back, so that a text is read no further than the second.
FIRST_TWO = r"(?s)^(?>.*?(\p{L}{6,}+))(?>.*?(\p{L}{6,}+))"
_FOLD = "strip_accents(lower(trim({})))"
_TERMS = rf"regexp_extract_all({_FOLD}, '[\p{{{{L}}}}\p{{{{N}}}}]+')"
_INDEX = rf"""e AS (SELECT t[1] AS entity, list_sort(list(DISTINCT t[2])) AS aliases FROM (SELECT regexp_extract_all(text, '\p{{L}}{{6,}}') AS t FROM documents) WHERE len(t) >= 2 GROUP BY t[1]),
f AS (SELECT entity, 'name' AS field, {_TERMS.format("entity")} AS terms FROM e UNION ALL SELECT entity, 'alias', flatten(list_transform(aliases, lambda a: {_TERMS.format("a")})) FROM e),
z AS (SELECT field, count(*) AS n, avg(len(terms)) AS avgdl FROM f WHERE len(terms) > 0 GROUP BY field),
c AS (SELECT entity, field, len, term, count(*) AS tf FROM (SELECT entity, field, len(terms) AS len, unnest(terms) AS term FROM f) GROUP BY ALL),
d AS (SELECT field, term, count(*) AS df FROM c GROUP BY ALL),
p AS (SELECT term, entity, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS weight FROM c JOIN d USING (field, term) JOIN z USING (field) GROUP BY term, entity),
q AS (SELECT item_id AS qid, unnest(list_distinct({_TERMS.format("text")})) AS term FROM benchmark),
s AS (SELECT qid, entity, round(sum(weight), 9) AS score FROM q JOIN p USING (term) GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity) AS r FROM s)"""


def _entities(spark, sf_dir):
    """The first two long words of each document, read once: index, mentions and relations all ask for them."""
    documents = table(spark, sf_dir, "documents")
    rows = documents.select(F.regexp_extract("text", FIRST_TWO, 1).alias("entity"), F.regexp_extract("text", FIRST_TWO, 2).alias("alias")).where("alias <> ''")
    return kept(rows.select("entity", F.array("alias").alias("aliases")), "entities")


def _asked(spark, sf_dir):
    """The items in capitals and without marks: only folding finds what they name.

    Capitals are those of a to z, which folding takes back: ``upper`` makes two letters of a sharp s, another word.
    """
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.translate(E.fold(F.col("text")), ascii_lowercase, ascii_uppercase).alias("text"))


@query(f"WITH {_INDEX} SELECT qid, entity, score, CAST(r - 1 AS INTEGER) AS rank FROM m WHERE r <= {_K}")
def ret4_entity_match(spark, sf_dir):
    """The best entities of each question, by folded names and aliases."""
    return E.match(_asked(spark, sf_dir), E.build(_entities(spark, sf_dir)), _K)


def search_sql(k: int, best: int) -> str:
    """The ``k`` documents by the ``best`` entities of each question."""
    return f"""WITH {_INDEX}, v AS MATERIALIZED (SELECT DISTINCT entity, unnest(list_append(list_transform(aliases, lambda a: {_FOLD.format("a")}), {_FOLD.format("entity")})) AS name FROM e WHERE entity IN (SELECT entity FROM m WHERE r <= {best})),
x AS MATERIALIZED (SELECT doc_id, {_FOLD.format("text")} AS t FROM documents), n AS (SELECT DISTINCT entity, doc_id AS id FROM v JOIN x ON contains(t, name)),
h AS (SELECT qid, id, score, entity, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id, entity) AS r FROM m JOIN n USING (entity) WHERE m.r <= {best}),
y AS (SELECT entity, unnest(aliases) AS other FROM e), b AS (SELECT entity, list_sort(list(DISTINCT other)) AS neighbours FROM (SELECT entity, other FROM y UNION ALL SELECT other, entity FROM y) WHERE entity <> other GROUP BY entity)
SELECT qid, id, score, CAST(h.r - 1 AS INTEGER) AS rank, entity, coalesce(neighbours, []) AS neighbours FROM h LEFT JOIN b USING (entity) WHERE h.r <= {k}"""


@query(search_sql(_K, _BEST))
def ret4_entity_search(spark, sf_dir):
    """Documents that mention the three best entities of each question, with neighbours (an entity and its alias are related)."""
    e = _entities(spark, sf_dir)
    asked, postings = _asked(spark, sf_dir), E.build(e)
    best = E.match(asked, postings, _BEST)
    known = e.join(best.select("entity").distinct(), "entity", "left_semi")  # only matched entities go into the automaton
    relations = e.select(F.col("entity").alias("source"), F.explode("aliases").alias("target"))
    return E.search(asked, postings, E.mentions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), known), relations, _K, _BEST)
