"""Overwrites by deltas against a rebuild with sets."""

import random
import uuid

from pyspark.sql import functions as F

from weftmill.operators import ingest as I


class Model:
    """The same store as Python sets, every count and prune by a full scan."""

    def __init__(self):
        self.docs, self.chunks, self.mentions, self.entities, self.relations = {}, {}, set(), {}, {}

    def overwrite(self, docs, chunks, entities, relations):
        report = {}
        given = {}
        for doc, path, title, topic in docs:
            given[doc] = min((d for d, (p, _, _) in self.docs.items() if p == path and p is not None), default=doc)
        for doc, path, title, topic in docs:
            self.docs[given[doc]] = (path, title, topic)
        fresh = {f"{given[d]}:{c}": (given[d], text, head) for d, c, text, head in chunks}
        for i, (d, text, _) in list(self.chunks.items()):
            if d in given.values() and i not in fresh:
                report[i] = "stale"
                del self.chunks[i]
                self.mentions = {m for m in self.mentions if m[1] != i}
        for i, row in fresh.items():
            old = self.chunks.get(i)
            report[i] = "new" if old is None else "kept" if old[1] == row[1] else "changed"
            if report[i] == "changed":
                self.mentions = {m for m in self.mentions if m[1] != i}
            self.chunks[i] = row
        for d, name, aliases in entities:
            self.entities[name] = tuple(aliases or ())
            for i, (cd, text, _) in fresh.items():
                if cd == given[d] and any(t.strip().lower() in (text or "").lower() for t in [name, *(aliases or ())] if t.strip()):
                    self.mentions.add((name, i))
        keys = {}
        for n in sorted(self.entities, reverse=True):
            keys[n.upper()] = n
        for _, a, b, words in relations:
            if a.upper() in keys and b.upper() in keys:
                self.relations[keys[a.upper()], keys[b.upper()]] = words
        said = {e for e, _ in self.mentions}
        self.relations = {k: v for k, v in self.relations.items() if k[0] in said or k[1] in said}
        ends = {e for k in self.relations for e in k}
        self.entities = {n: a for n, a in self.entities.items() if n in said or n in ends}
        return report


def embed(rows):
    return rows.withColumn("vector", F.array(F.length("text").cast("double")))


def batch(spark, docs, chunks, entities, relations):
    return I.Batch(
        spark.createDataFrame(docs, "doc string, path string, title string, topic string"), spark.createDataFrame(chunks, "doc string, chunk string, text string, heading_path string"),
        spark.createDataFrame(entities, "doc string, name string, aliases array<string>"), spark.createDataFrame(relations, "doc string, source string, target string, keywords string"),
    )


def check(store, model):
    assert {r.doc: (r.path, r.title, r.topic) for r in store.documents.collect()} == model.docs
    assert {r.id: (r.doc, r.text, r.heading_path) for r in store.chunks.collect()} == model.chunks
    mentions = [(r.entity, r.id) for r in store.mentions.collect()]
    assert len(mentions) == len(set(mentions)) and set(mentions) == model.mentions
    assert {(r.source, r.target): r.keywords for r in store.relations.collect()} == model.relations
    rows = {r.name: r for r in store.entities.collect()}
    assert {n: tuple(r.aliases) for n, r in rows.items()} == model.entities
    for n, r in rows.items():
        assert r.mentioned == sum(e == n for e, _ in model.mentions), n
        assert r.related == sum(k.count(n) for k in model.relations), n


def test_overwrites_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    model, store = Model(), I.Store.empty(spark)
    names = ["Ada", "Bob", "Cyd", "Dee", "Eve", "Fay"]
    for turn in range(3):
        chosen = rng.sample(range(6), 3)
        docs = [(f"d{i}" if turn == 0 or i > 2 else f"again{turn}-{i}", f"p{i}.md", f"T{turn}", "x") for i in chosen]
        chunks = [(d, f"c{j}", " ".join(rng.choices([*names, "lorem", "DEE"], k=3)), "# A > ## B") for d, *_ in docs for j in rng.sample(range(4), 3)]
        entities = [(d, n, [n.lower() + "x"]) for n in names for d, *_ in docs if rng.random() < 0.4]
        relations = [(docs[0][0], a.lower(), b, f"{turn}") for a in names for b in names if a < b and rng.random() < 0.3]
        change = I.overwrite(store, batch(spark, docs, chunks, entities, relations), embed)
        report = {r.id: r.state for r in change.report.collect()}
        store = change.apply(store).save(f"file://{tmp_path}/{uuid.uuid4().hex}")
        assert report == model.overwrite(docs, chunks, entities, relations)
        check(store, model)


def test_known_text_keeps_its_vector_and_sections_are_rebuilt(spark, tmp_path):
    first = batch(spark, [("doc", "w/a.md", "A", "t")], [("doc", "1", "same", "# X"), ("doc", "2", "old", "# X > ## Y"), ("doc", "3", "gone", None)], [], [])
    store = I.overwrite(I.Store.empty(spark), first, embed).apply(I.Store.empty(spark)).save(f"file://{tmp_path}/a")
    store.documents = store.documents.withColumn("read_count", F.lit(9).cast("long"))
    second = batch(spark, [("other", "w/a.md", "B", "t")], [("other", "1", "same", "# Z"), ("other", "2", "newer", "# X > ## Y")], [], [])
    seen = []

    def count(rows):
        seen.extend(r.text for r in rows.collect())
        return rows.withColumn("vector", F.array(F.lit(0.5)))

    change = I.overwrite(store, second, count)
    after = change.apply(store).save(f"file://{tmp_path}/b")
    assert seen == ["newer"]
    assert {(r.id, tuple(r.vector), r.section) for r in after.chunks.collect()} == {("doc:1", (4.0,), "doc#Z"), ("doc:2", (0.5,), "doc#X > Y")}
    assert {(r.id, r.parent) for r in after.sections.collect()} == {("doc#Z", None), ("doc#X", None), ("doc#X > Y", "doc#X")}
    assert [(r.doc, r.title, r.read_count) for r in after.documents.collect()] == [("doc", "B", 9)]
    nothing = batch(spark, [], [], [], [])
    assert I.overwrite(after, nothing, embed).apply(after).chunks.count() == 2


def test_delete_takes_all_that_hangs_on_a_document(spark, tmp_path):
    b = batch(spark, [("a", "a.md", "A", "t"), ("b", "b.md", "B", "t")], [("a", "1", "Ada and Bob", "# H"), ("b", "1", "Bob", None)], [("a", "Ada", None), ("a", "Bob", None), ("b", "Bob", None)], [("a", "Ada", "Bob", "k")])
    store = I.overwrite(I.Store.empty(spark), b, embed).apply(I.Store.empty(spark)).save(f"file://{tmp_path}/a")
    left = I.delete(store, spark.createDataFrame([("a",)], "doc string")).apply(store).save(f"file://{tmp_path}/b")
    assert [r.doc for r in left.documents.collect()] == ["b"] and [r.id for r in left.chunks.collect()] == ["b:1"]
    assert {(r.name, r.mentioned, r.related) for r in left.entities.collect()} == {("Ada", 0, 1), ("Bob", 1, 1)} and left.sections.count() == 0
    none = I.delete(left, spark.createDataFrame([("b",)], "doc string")).apply(left)
    assert none.entities.count() == none.relations.count() == none.mentions.count() == 0


def test_overwrite_by_sort_merge_joins(spark, tmp_path):
    """As on large tables, where no side is broadcast: the union of old and new names stays joinable by key."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = lambda turn: batch(spark, *(rows for rows in (
            [(f"d{i}", f"p{i}.md", f"T{turn}", "x") for i in range(40)], [(f"d{i}", "c", f"Name{i + turn} and Other{i}", "# A") for i in range(40)],
            [(f"d{i}", n, None) for i in range(40) for n in (f"Name{i + turn}", f"Other{i}")], [(f"d{i}", f"name{i + turn}", f"other{i}", "k") for i in range(40)],
        )))
        empty = I.Store.empty(spark)
        store = I.overwrite(empty, docs(0), embed).apply(empty).save(f"file://{tmp_path}/a")
        after = I.overwrite(store, docs(1), embed).apply(store).save(f"file://{tmp_path}/b")
        assert after.relations.count() == 80 and after.mentions.count() == 80
        assert {(r.name, r.mentioned, r.related) for r in after.entities.where("name in ('Name0', 'Name1', 'Name40', 'Other3')").collect()} == {("Name0", 0, 1), ("Name1", 1, 2), ("Name40", 1, 1), ("Other3", 1, 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_report_alone_makes_no_mentions_and_writes_nothing(spark, monkeypatch):
    """Chunk states hang on documents and chunks; entities, mentions and relations are made when they are asked for."""
    from weftmill.plans import ingest as plans

    def pairs(*_):
        raise AssertionError("mentions were made")

    b = batch(spark, [("a", "a.md", "A", "t")], [("a", "1", "Ada and Bob", "# H")], [("a", "Ada", None)], [("a", "Ada", "Ada", "k")])
    whole, pairs_of = I.overwrite(I.Store.empty(spark), b, embed), I.pairs
    monkeypatch.setattr(I, "pairs", pairs)
    change, written = I.overwrite(I.Store.empty(spark), b, embed), []
    assert [(r.id, r.state) for r in change.report.collect()] == [("a:1", "new")] and change.table(I.Store.empty(spark), "chunks").count() == 1
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda *a, **k: written.append(a))
    report = plans.mut3_overwrite_states(spark, "/root/testdata/sf0.001")
    assert not written and {r.state for r in report.select("state").distinct().collect()} == {"stale", "changed", "kept"}
    monkeypatch.undo()
    assert I.pairs is pairs_of and [r.entity for r in whole.apply(I.Store.empty(spark)).mentions.collect()] == ["Ada"]


def test_given_names_of_one_document_are_one(spark):
    """Two given names of one path are one document, the greater name's chunks are its chunks, and repeated chunks count once."""
    first = batch(spark, [("d", "p.md", "A", "t")], [("d", "1", "old", None)], [], [])
    store = I.overwrite(I.Store.empty(spark), first, embed).apply(I.Store.empty(spark))
    again = batch(spark, [("x", "p.md", "B", "t"), ("y", "p.md", "C", "t"), ("z", "q.md", "D", "t")], [("x", "1", "of x", None), ("y", "1", "a", None), ("y", "1", "b", None), ("z", "1", "new", None), ("w", "1", "of none", None)], [], [])
    change = I.overwrite(store, again, embed)
    assert {(r.id, r.doc, r.state) for r in change.report.collect()} == {("d:1", "d", "changed"), ("z:1", "z", "new")}
    assert {(r.id, r.text) for r in change.table(store, "chunks").collect()} == {("d:1", "b"), ("z:1", "new")}
