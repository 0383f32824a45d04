"""Ingest and overwrite of documents in one call, by deltas.

The store is a set of tables (``Store``). ``overwrite`` takes a batch of new versions of any number of documents and gives a
``Change``: for each table the rows that go and the rows that come. Dependent counts are kept, not recounted: an entity's
row holds how many chunks mention it and how many relations it has, each change adds and subtracts its own edges, and only
entities whose count this change brings to zero are asked whether a relation or an entity must go. Work grows with the batch and with
what its documents hold, but for one equi-join of each table with the keys that the change names.

What a change does: a document is found by its path, else by the given id; chunks that are no longer there go with their mentions; chunks of
the same text that have a vector keep it, all others are embedded; sections are rebuilt from heading paths; a changed chunk's mentions
are read anew; entities and relations are merged, the last of a batch wins; relations neither of whose ends is mentioned, and then entities
without mention and relation, go.

A document that the store doesn't know is new; null texts mention nothing; repeated rows of a batch count once (the last position
wins); a relation whose end is no entity is left out; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmill.functions.text import fold_key
from weftmill.scratch import kept

TABLES = {
    "documents": ("doc string, path string, title string, topic string, read_count long, confidence double", ["doc"]),
    "chunks": ("id string, doc string, text string, heading_path string, section string, vector array<double>", ["id"]),
    "sections": ("id string, doc string, path string, title string, parent string", ["id"]),
    "entities": ("name string, key string, aliases array<string>, mentioned long, related long", ["name"]),
    "mentions": ("entity string, id string, doc string", ["entity", "id"]),
    "relations": ("source string, target string, keywords string", ["source", "target"]),
}


@dataclass
class Store:
    documents: DataFrame
    chunks: DataFrame
    sections: DataFrame
    entities: DataFrame
    mentions: DataFrame
    relations: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(**{name: spark.createDataFrame([], ddl).limit(0) for name, (ddl, _) in TABLES.items()})  # the limit tells the optimizer, which drops joins with them

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> Store:
        return cls(**{name: spark.read.schema(ddl).parquet(f"{base}/{name}") for name, (ddl, _) in TABLES.items()})

    def save(self, base: str) -> Store:
        """Write a version into a folder of its own (it must not exist) and read it back: the lineage ends there."""
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{base}/{f.name}")
        return Store.load(self.documents.sparkSession, base)


@dataclass
class Batch:
    """New versions: ``documents`` (doc, path, title, topic), ``chunks`` (doc, chunk, text, heading_path), ``entities`` (doc, name, aliases), ``relations`` (doc, source, target, keywords)."""

    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame


class Rows(dict):
    """Rows by table; the tables that are not there yet are made, all at once, when one of them is first asked for."""

    def __init__(self, now: dict[str, DataFrame], later: Callable[[], dict[str, DataFrame]]):
        super().__init__(now)
        self.later = later

    def __missing__(self, name: str) -> DataFrame:
        for table, rows in self.later().items():
            self.setdefault(table, rows)
        return dict(self)[name]


@dataclass
class Change:
    """Rows that go (by key) and rows that come, for each table, and what became of each chunk."""

    gone: Rows
    come: Rows
    report: DataFrame

    def table(self, store: Store, name: str) -> DataFrame:
        """One table after the change."""
        (_, keys), old, new = TABLES[name], getattr(store, name), self.come[name]
        kept = old.join(self.gone[name].select(*keys).unionByName(new.select(*keys)), keys, "left_anti")
        return kept.unionByName(new.select(old.columns))

    def apply(self, store: Store) -> Store:
        return Store(**{name: self.table(store, name) for name in TABLES})


def sections(doc: Column, heading_path: Column) -> Column:
    """The chain of sections that a heading path such as ``# A > ## B`` names, outermost first: id, path, title, parent."""
    titles = F.filter(F.transform(F.split(F.coalesce(heading_path, F.lit("")), " > "), lambda t: F.trim(F.regexp_replace(t, r"^\s*#+\s*", ""))), lambda t: t != "")
    path = lambda n: F.array_join(F.slice(titles, 1, n), " > ")
    ident = lambda n: F.concat(doc, F.lit("#"), path(n))
    one = lambda t, i: F.struct(ident(i + 1).alias("id"), path(i + 1).alias("path"), t.alias("title"), F.when(i > 0, ident(i)).alias("parent"))
    return F.transform(titles, one)


def _last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def _none(rows: DataFrame) -> bool:
    """Whether the plan says that there are no rows, as with an empty store."""
    most = rows._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0


def pairs(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity, id, doc``: the chunks of a document whose text holds the name or an alias of one of its entities, in any case.

    A document names an entity once (``entities``: doc, name, aliases), so each chunk and entity meet once and nothing needs to be made distinct.
    """
    terms = F.filter(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")), lambda t: F.length(F.trim(t)) > 0)
    named = entities.select("doc", F.col("name").alias("entity"), F.transform(terms, lambda t: F.lower(F.trim(t))).alias("terms"))
    low = chunks.withColumn("low", F.lower("text")).join(named, "doc")
    return low.where(F.exists("terms", lambda t: F.contains(F.col("low"), t))).select("entity", "id", "doc")


def overwrite(store: Store, batch: Batch, embed: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = kept) -> Change:
    """The change that the new versions make.

    ``embed`` adds a column ``vector`` to rows with a ``text``; ``keep`` writes a frame that is used
    more than once (documents, chunk states, entities, deltas, counts) and reads it back. Documents, chunks, sections and the
    report come first; entities, mentions and relations are made when one of them is asked for, so the report alone costs no mention.
    """
    store = replace(store)  # as it is now, also for what is made later
    given = _last(batch.documents, ["doc"], [F.col("path").desc_nulls_last(), F.desc("title")]).withColumn("given", F.col("doc"))
    if _none(store.documents):  # no path and no doc to find; the given names hold, and the partitions by them
        documents = given.select("given", "doc", "path", "title", "topic", F.lit(0).cast("long").alias("read_count"), F.lit(1.0).alias("confidence"))
    else:
        known = store.documents.where("path is not null").groupBy("path").agg(F.min("doc").alias("old"), F.max("read_count").alias("reads"), F.max("confidence").alias("sure"))
        byid = store.documents.groupBy("doc").agg(F.max("read_count").alias("own_reads"), F.max("confidence").alias("own_sure"))  # one row a doc; said by a group, the join goes where its columns aren't used
        named = given.join(known, "path", "left").withColumn("doc", F.coalesce("old", "doc")).join(byid, "doc", "left")
        documents = _last(named.select("given", "doc", "path", "title", "topic", F.coalesce("reads", "own_reads", F.lit(0)).cast("long").alias("read_count"), F.coalesce("sure", "own_sure", F.lit(1.0)).alias("confidence")), ["doc"], [F.desc("given")])
    documents = keep(documents)
    ids = documents.select("given", F.col("doc").alias("doc_"))

    def mine(rows: DataFrame) -> DataFrame:
        return rows.join(ids, rows["doc"] == ids["given"]).drop("doc", "given").withColumnRenamed("doc_", "doc")

    # chunks: kept, embedded again, stale
    chain = sections(F.col("doc"), F.col("heading_path"))
    fresh = _last(batch.chunks.join(ids, F.col("doc") == F.col("given")), ["given", "chunk"], [F.desc_nulls_last("text")])  # one doc_ a given; partitioned by the join already
    fresh = fresh.select(F.concat_ws(":", "doc_", F.col("chunk").cast("string")).alias("id"), F.col("doc_").alias("doc"), "text", "heading_path")
    touched = store.chunks.join(documents.select("doc"), "doc", "left_semi").select("id", F.col("doc").alias("was_doc"), F.col("text").alias("was"), F.col("vector").alias("held"))
    both = touched.join(fresh, "id", "full_outer")
    same = F.col("was_doc").isNotNull() & F.col("was").eqNullSafe(F.col("text")) & F.col("held").isNotNull()
    state = F.when(F.col("doc").isNull(), "stale").when(same, "kept").when(F.col("was_doc").isNull(), "new").otherwise("changed")
    both = keep(both.withColumn("state", state))
    fresh = both.where("doc is not null").select("id", "doc", "text", "heading_path")  # as kept, so it isn't made again
    held, again = both.where("state = 'kept' and held is not null").withColumn("vector", F.col("held")), embed(both.where("state in ('new', 'changed')"))
    chunks = held.unionByName(again).withColumn("section", F.try_element_at(chain, F.lit(-1))["id"])
    linked = fresh.select("doc", F.explode(chain).alias("s")).select("s.id", "doc", "s.path", "s.title", "s.parent").distinct()
    old_sections = store.sections.join(documents.select("doc"), "doc", "left_semi").select("id")

    @cache
    def linked_rows() -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        # mentions: those of stale and changed chunks go, those of every present chunk with the document's entities come
        entities = keep(_last(mine(batch.entities).where("name is not null"), ["doc", "name"], [F.desc_nulls_last("aliases")]).select("doc", "name", "aliases"))
        wanted = pairs(fresh.select("id", "doc", "text"), entities)
        lost = both.where("state in ('stale', 'changed')").select("id").distinct().withColumn("lost", F.lit(True))
        had = store.mentions.join(documents.select("doc"), "doc", "left_semi").join(lost, "id", "left").select("entity", "id", F.col("doc").alias("had_doc"), "lost")
        met = wanted.join(had, ["entity", "id"], "full_outer").where("had_doc is null or (doc is null and lost)")
        moves = keep(met.select("entity", "id", F.coalesce("doc", "had_doc").alias("doc"), F.when(F.col("doc").isNull(), -1).otherwise(1).alias("step")))

        # entities and relations of the batch
        merged = keep(_last(entities, ["name"], [F.desc("doc")]).select("name", fold_key(F.col("name")).alias("key"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")))
        rel = keep(mine(batch.relations).withColumn("a", fold_key(F.col("source"))).withColumn("b", fold_key(F.col("target"))).select("a", "b", "doc", "keywords"))
        # no semi-join by the ends asked for: it moves below the union, which then counts as partitioned by key until a reused exchange undoes that ("Can't zip RDDs")
        by_key = store.entities.select("name", "key").unionByName(merged.select("name", "key")).groupBy("key").agg(F.min("name").alias("name"))
        rel = rel.join(by_key.select(F.col("key").alias("a"), F.col("name").alias("source")), "a").join(by_key.select(F.col("key").alias("b"), F.col("name").alias("target")), "b")
        rel = keep(_last(rel, ["source", "target"], [F.desc("doc"), F.desc_nulls_last("keywords")]).select("source", "target", "keywords"))
        new_edges = rel.select("source", "target").join(store.relations.select("source", "target"), ["source", "target"], "left_anti")

        # counts by deltas
        def degree(edges: DataFrame, step: int) -> DataFrame:
            return edges.select(F.explode(F.array("source", "target")).alias("name"), F.lit(step).alias("r"))

        mention_delta = moves.groupBy(F.col("entity").alias("name")).agg(F.sum("step").alias("m"))
        relation_delta = degree(new_edges, 1).groupBy("name").agg(F.sum("r").alias("r"))
        delta = mention_delta.join(relation_delta, "name", "full_outer").join(merged.select("name", F.col("aliases").alias("fresh")), "name", "full_outer")
        counted = delta.join(store.entities.select("name", "aliases", "mentioned", "related"), "name", "left").select(
            "name", fold_key(F.col("name")).alias("key"), F.coalesce("fresh", "aliases").alias("aliases"), (F.coalesce("mentioned", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("mentioned"), (F.coalesce("related", F.lit(0)) + F.coalesce("r", F.lit(0))).alias("related")
        )
        counted = keep(counted)

        # relations that may have lost their last mentioned end: those of entities at zero, old or new
        silent = counted.where("mentioned = 0").select("name")
        edges = store.relations.select("source", "target").unionByName(new_edges)
        near = edges.join(silent.withColumnRenamed("name", "source"), "source", "left_semi").unionByName(edges.join(silent.withColumnRenamed("name", "target"), "target", "left_semi")).distinct()
        spoken = store.entities.select("name", "mentioned").join(counted.select("name"), "name", "left_anti").unionByName(counted.select("name", "mentioned")).where("mentioned > 0").select("name")
        pruned = keep(near.join(spoken.withColumnRenamed("name", "source"), "source", "left_anti").join(spoken.withColumnRenamed("name", "target"), "target", "left_anti"))
        less = degree(pruned, -1).groupBy("name").agg(F.sum("r").alias("less"))
        others = store.entities.join(counted.select("name"), "name", "left_anti").join(less.select("name"), "name", "left_semi").select("name", "key", "aliases", "mentioned", "related")
        final = keep(counted.unionByName(others).join(less, "name", "left").withColumn("related", F.col("related") + F.coalesce("less", F.lit(0))).drop("less"))
        lonely = (F.col("mentioned") == 0) & (F.col("related") == 0)

        gone = {"entities": final.where(lonely).select("name"), "mentions": moves.where("step = -1").select("entity", "id"), "relations": pruned.select("source", "target")}
        come = {"entities": final.where(~lonely), "mentions": moves.where("step = 1").select("entity", "id", "doc"), "relations": keep(rel.join(pruned, ["source", "target"], "left_anti"))}
        return gone, come

    gone = {"documents": documents.select("doc"), "chunks": both.where("state = 'stale'").select("id"), "sections": old_sections}
    come = {
        "documents": documents.select("doc", "path", "title", "topic", "read_count", "confidence"), "chunks": chunks.select("id", "doc", "text", "heading_path", "section", "vector"), "sections": linked,
    }
    return Change(Rows(gone, lambda: linked_rows()[0]), Rows(come, lambda: linked_rows()[1]), both.select("id", F.coalesce("doc", "was_doc").alias("doc"), "state"))


def delete(store: Store, docs: DataFrame) -> Change:
    """The change that deletes documents (doc) with all that hangs on them: an overwrite by nothing that drops the document as well."""
    spark = store.documents.sparkSession
    gone = store.documents.join(docs.select("doc").distinct(), "doc", "left_semi")
    none = Batch(gone.select("doc", F.lit(None).cast("string").alias("path"), "title", "topic"), *(spark.createDataFrame([], ddl) for ddl in ("doc string, chunk string, text string, heading_path string", "doc string, name string, aliases array<string>", "doc string, source string, target string, keywords string")))
    change = overwrite(store, none, lambda rows: rows.withColumn("vector", F.col("held")))
    change.come["documents"] = store.documents.limit(0)
    return change
