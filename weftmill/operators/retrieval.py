"""Batch retrieval: every function takes a table of queries and returns ranked hits for all of them at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmill.functions.text import TOKEN, tokens
from weftmill.scratch import kept

RRF_K = 60
QUERY_BLOCK = 1024
TEXTS, ROWS, CELLS = 64, 256, 1 << 17  #: what a worker holds at once: texts, scored rows, (term, query) pairs of rows


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 if either is a zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def top(rows: DataFrame, k: int, key: str = "qid", score: str = "score", ident: str = "id") -> DataFrame:
    """The ``k`` best of each query with a 0-based ``rank``; ties go to the smaller id.

    The rank limit is applied before the exchange as well, so a query costs at most ``k`` rows a task.
    """
    w = Window.partitionBy(key).orderBy(F.desc(score), ident)
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank") - 1)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``qid, id, score, rank``: exact cosine top-k; filter ``corpus`` first to search within a scope.

    Queries are a stated set: they are taken in blocks of ``QUERY_BLOCK`` rows, each block a pass over the corpus in
    which a task keeps its own best ``k``; scores are rounded before they are ranked, so ties are the same everywhere.
    """
    found = None
    held = queries.select(F.col("qid").cast("long"), F.col("vector").cast("array<double>")).orderBy("qid").toLocalIterator()
    for block in _blocks(held):
        ids, q = np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for batch in _cut(batches, ROWS):
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(flat, axis=1, keepdims=True)
                best.add(batch.column("id").to_numpy(zero_copy_only=False), np.round(q @ (flat / np.where(norm == 0, 1, norm)).T, digits))
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.ids), pa.array(best.scores)], names=["qid", "id", "score"])

        part = corpus.select(F.col("id").cast("long"), F.col("vector").cast("array<float>")).mapInArrow(scan, "qid long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "qid long, id long, score double")
    return top(found, k)


def _runs(done: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes, given by their running sum, are about ``most`` together."""
    lo = 0
    while lo < len(done):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


class Best:
    """The ``k`` best rows of each query so far, best first (not-a-number before all, as in SQL); ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray, above: float = -np.inf) -> None:
        """Rows with their scores (query, row); only scores over ``above`` count."""
        new, at = np.nonzero(~((scores < self.floor[:, None]) | (scores <= above)))
        if not len(new):
            return
        query, ids, scores = np.concatenate([self.query, new]), np.concatenate([self.ids, ids[at]]), np.concatenate([self.scores, scores[new, at]])
        order = np.lexsort((ids, np.where(np.isnan(scores), -np.inf, -scores), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.floor[query[place == self.k - 1]] = scores[order[place[place < self.k] == self.k - 1]]
        self.query, self.ids, self.scores = query[place < self.k], ids[order], scores[order]


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows, so that what is made of them doesn't grow with Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _blocks(rows: Iterator) -> Iterator[list]:
    block = []
    for r in rows:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def postings(corpus: DataFrame) -> DataFrame:
    """``id, term, tf, len``: term counts and document lengths in tokens."""
    t = corpus.select("id", tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


_COUNTS = pa.schema([("id", pa.int64()), ("len", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])


def counted(batches: Iterator[pa.RecordBatch], terms: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Texts (id, text) as their length in tokens and counts of the wanted terms; ``TEXTS`` of them are held as strings at once."""
    import regex

    word = regex.compile(TOKEN)
    for batch in _cut(batches, TEXTS):
        size, numbers, counts = [], [], []
        for text in batch.column("text"):
            found = word.findall(text.as_py() or "")
            own = Counter(filter(terms.__contains__, found))
            size.append(len(found))
            numbers.append([terms[t] for t in own])
            counts.append(list(own.values()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, type=f.type) for v, f in zip((size, numbers, counts), list(_COUNTS)[1:], strict=True))], schema=_COUNTS)


def _counts(corpus: DataFrame, terms: dict[str, int]) -> DataFrame:
    """``id, len, terms, tfs``: each text read once, its length in tokens and how often it holds each wanted term (by number)."""
    return corpus.select(F.col("id").cast("long"), F.lower("text").alias("text")).mapInArrow(lambda batches: counted(batches, terms), "id long, len long, terms array<int>, tfs array<int>")


def bm25(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """``qid, id, score, rank``: BM25 top-k of query texts (a bag of distinct words).

    Queries are a stated set, taken in blocks of ``QUERY_BLOCK``. For each block every text is read once into its length and its counts
    of the block's terms, a small table from which document frequencies are summed; then a task scores ``ROWS`` documents at a time
    against all queries of the block, through the queries that hold each term, and keeps its own best ``k``. So no row for a
    pair of query and document is ever exchanged, and what a worker holds is bounded: a few texts, the scores of a few documents, and
    its best. Frequencies and lengths are those of the whole corpus.
    """
    spark, key = queries.sparkSession, queries.schema["qid"]
    asked = queries.select("qid", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("terms")).orderBy("qid").toLocalIterator()
    every = None
    for held in _blocks(asked):
        words = {t: i for i, t in enumerate(dict.fromkeys(t for r in held for t in r["terms"]))}
        if not words:
            continue
        table = kept(_counts(corpus, words), "counts")
        size = table.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).first()
        df = np.zeros(len(words))
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a number for each term of the block
            df[r["t"]] = r["n"]
        idf = np.log(1 + (size["n"] - df + 0.5) / (df + 0.5))
        asks = sorted((words[t], q) for q, r in enumerate(held) for t in r["terms"])
        of = np.array([q for _, q in asks], dtype=np.int64)  # the queries of term t: of[ends[t] : ends[t + 1]]
        ends = np.searchsorted([t for t, _ in asks], np.arange(len(words) + 1))
        n_queries, avgdl = len(held), size["avgdl"] or 1.0

        def score(batches: Iterator[pa.RecordBatch], idf=idf, of=of, ends=ends, n_queries=n_queries, avgdl=avgdl) -> Iterator[pa.RecordBatch]:
            best = Best(n_queries, k)
            asked_by = np.diff(ends)
            for batch in _cut(batches, ROWS):
                ids, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "len"))
                lists = batch.column("terms")
                doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                term, tf = lists.flatten().to_numpy(zero_copy_only=False), batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avgdl))
                scores = np.zeros(len(ids) * n_queries)
                n, done = asked_by[term], np.cumsum(asked_by[term])
                for lo, hi in _runs(done, CELLS):
                    few = n[lo:hi]
                    cell = np.repeat(doc[lo:hi] * n_queries, few) + of[np.repeat(ends[term[lo:hi]] - np.cumsum(few) + few, few) + np.arange(few.sum())]
                    first = int(doc[lo]) * n_queries
                    part = np.bincount(cell - first, np.repeat(weight[lo:hi], few))
                    scores[first : first + len(part)] += part
                best.add(ids, np.round(scores.reshape(len(ids), n_queries).T, digits), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(best.query.astype(np.int32)), pa.array(best.ids), pa.array(best.scores)], names=["q", "id", "score"])

        found = table.mapInArrow(score, "q int, id long, score double")
        names = spark.createDataFrame([(i, r["qid"]) for i, r in enumerate(held)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", key.dataType)]))
        part = top(found, k, key="q").join(names, "q").select("qid", "id", "score", "rank")
        every = part if every is None else every.unionByName(part)
    if every is None:
        return spark.createDataFrame([], T.StructType([T.StructField("qid", key.dataType), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return every


def rrf(lists: list[DataFrame], k: int, constant: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion: a hit adds ``1 / (constant + rank + 1)`` each time it is listed.

    Returns ``qid, id, fused, score, source, rank``; ``score`` and ``source`` come from the first list that has the id.
    """
    every = None
    for i, hits in enumerate(lists):
        part = hits.select("qid", "id", "score", "rank", F.lit(i).alias("source"))
        every = part if every is None else every.unionByName(part)
    first = F.min_by(F.struct("score", "source"), F.struct("source", "rank"))
    fused = every.groupBy("qid", "id").agg(F.round(F.sum(1 / (constant + F.col("rank") + 1)), digits).alias("fused"), first.alias("first"), F.min(F.struct("source", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc("fused"), "seen", "id")
    out = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("qid", "id", "fused", F.col("first.score").alias("score"), F.col("first.source").alias("source"), (F.col("rank") - 1).alias("rank"))


def mentions(chunks: DataFrame, entities: DataFrame, most_terms: int = 200_000) -> DataFrame:
    """``entity, id``: chunks whose text holds an entity's name or alias, in any case.

    All terms go into one Aho-Corasick automaton, which reads each text once. Entity dictionaries are curated and small;
    the number of terms is checked, and beyond ``most_terms`` they are taken in several automata, each a pass.
    """
    import ahocorasick

    terms = entities.select("entity", F.explode(F.array_distinct(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("entity")), F.lower))).alias("term")).where(F.length("term") > 0)
    n = terms.count()
    parts = max(1, -(-n // most_terms))
    found = None
    for p in range(parts):
        names: dict[str, list[str]] = {}
        for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p).collect():
            names.setdefault(r["term"], []).append(r["entity"])

        def scan(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            auto = ahocorasick.Automaton()
            for term, owners in names.items():
                auto.add_word(term, owners)
            auto.make_automaton()
            for batch in batches:
                ids, out, key = batch.column("id").to_pylist(), [], []
                for i, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                    seen = {e for _, owners in auto.iter((text or "").lower()) for e in owners} if names else set()
                    out += sorted(seen)
                    key += [i] * len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()), pa.array(key, type=pa.int64())], names=["entity", "id"])

        part = chunks.select(F.col("id").cast("long"), "text").mapInArrow(scan, "entity string, id long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def neighbours(relations: DataFrame) -> DataFrame:
    """``entity, neighbour`` of undirected relations, distinct."""
    both = relations.select(F.col("source").alias("entity"), F.col("target").alias("neighbour")).unionByName(relations.select(F.col("target").alias("entity"), F.col("source").alias("neighbour")))
    return both.where("entity <> neighbour").distinct()


def graph_topk(matched: DataFrame, mention: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """``qid, id, score, rank, entity, neighbours``: chunks that mention the entities a query matched (qid, entity, score)."""
    near = neighbours(relations).groupBy("entity").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))
    rows = matched.join(mention, "entity").join(near, "entity", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "entity")
    # a bare limit on the row number is also applied before the exchange: a query costs at most k rows a task
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def siblings(hits: DataFrame, chunks: DataFrame, n: int = 4) -> DataFrame:
    """Hits with up to ``n`` other chunks of the same section, in order; ``chunks``: id, section."""
    w = Window.partitionBy("section").orderBy("id")
    # the n + 1 smallest of a section hold the n smallest others of any member, so a large section never meets whole
    few = chunks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n + 1).groupBy("section").agg(F.array_sort(F.collect_list("id")).alias("near"))
    rows = hits.join(chunks.select("id", "section"), "id").join(few, "section", "left")
    return rows.withColumn("siblings", F.slice(F.filter("near", lambda x: x != F.col("id")), 1, n)).drop("near")


def rerank(hits: DataFrame, texts: DataFrame, queries: DataFrame, most: int = 20, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The best ``most`` hits of each query in a new order; the default score is the share of query words in the text."""
    overlap = lambda q, t: F.round(F.size(F.array_intersect(tokens(q), tokens(t))) / F.greatest(F.lit(1), F.size(F.array_distinct(tokens(q)))), 6)
    rows = hits.where(F.col("rank") < most).join(texts.select("id", F.col("text").alias("t")), "id").join(queries.select("qid", F.col("text").alias("q")), "qid")
    rows = rows.withColumn("score", (scorer or overlap)(F.col("q"), F.col("t"))).withColumnRenamed("rank", "before")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "before")
    return rows.withColumn("rank", F.row_number().over(w) - 1).select("qid", "id", "score", "rank")


def best_match(queries: DataFrame, corpus: DataFrame, threshold: float) -> DataFrame:
    """``qid, id, score`` of the most similar row at or above a threshold (score to 4 places)."""
    near = vector_topk(queries, corpus, 2).where(F.col("qid") != F.col("id"))
    return top(near.drop("rank"), 1).where(F.col("score") >= threshold).select("qid", "id", F.round("score", 4).alias("score"))


def in_scope(topic: Column, scope: str) -> Column:
    """A topic at or below a scope."""
    return (topic == scope) | topic.startswith(scope + "/")


def hop(edges: DataFrame, roots: DataFrame, k: int = 2) -> DataFrame:
    """``root, node, depth``: everything within ``k`` undirected hops; ``k`` is a small constant, so ``k`` joins."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, k + 1):
        step = front.join(both, front["node"] == both["source"]).select("root", F.col("target").alias("node"), F.lit(d).alias("depth")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes reached from a root."""
    a = reached.select("root", F.col("node").alias("source"))
    b = reached.select("root", F.col("node").alias("target"))
    return edges.join(a, "source").join(b, ["root", "target"]).select("root", "source", "target")
