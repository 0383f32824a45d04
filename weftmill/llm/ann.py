"""Nearest neighbours by inner product through an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook (k-means on a bounded, documented sample of
``sample`` distinct vectors). A cell is a pair of centroids; every vector is in the index. A query sorts both codebooks
by its negative inner products and walks the pairs by their sum with a heap, until the cells it has met hold at least
``probe`` vectors (all, if there are fewer); these are reranked by the exact inner product on the original vectors.
``probe`` is measured, not guessed, by the same rule at every size: ``judges`` of the queries are compared with every
vector, and it is the smallest number with which the walk would have met the share ``recall`` of their true neighbours.

Equal vectors are one index entry with its ``k + 1`` smallest ids (no result can hold more of them), and queries with
equal vectors are searched once, so copies of one vector, however many, cost one row. Codes are numbered along their
main direction, and neighbouring cells form regions of about ``region`` entries. A query travels once to each region
that holds a cell it has met, not once a cell; there it is compared with the region's entries in blocks of bounded size
(entries of the region that lie in cells it has not met come along and can only improve the result). A crowded cell is
many blocks in many tasks. Codebooks grow as the square root of the number of vectors, so cells keep their size; what is
shipped to all tasks is both codebooks and one count a cell, about ``n / cell`` numbers.

Components keep the width they have: floats stay floats on the way and are multiplied and summed as doubles; doubles
stay doubles.

Defined edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do null ids; of rows that share an id, one takes part (the smallest vector); with no other vector a
query has no rows; ties go to the smaller id; other columns are left alone.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmill.llm.common import arrow_schema, bounded_sample, materialize


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows that take part, one for each id."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``cid, v, ids``: each distinct vector, its smallest id and its ``k + 1`` smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)  # limited before the exchange, too
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")


def codebook(x: np.ndarray, codes: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means centroids (at most ``codes``), started from rows spread by a fixed rule."""
    x = np.unique(x, axis=0)
    if len(x) <= codes:
        return x
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), codes, replace=False))]
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        count = np.bincount(near, minlength=codes)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return along_main_direction(c)


def along_main_direction(c: np.ndarray) -> np.ndarray:
    """The centroids in the order of their projection on the direction of most variance: neighbours get near numbers."""
    d = c - c.mean(0)
    v = np.ones(c.shape[1])
    for _ in range(20):
        v = d.T @ (d @ v)
        v /= np.linalg.norm(v) or 1.0
    return c[np.argsort(d @ v, kind="stable")]


def regions(counts: np.ndarray, size: int) -> np.ndarray:
    """The region of each cell: runs of neighbouring cells with about ``size`` entries."""
    return (np.cumsum(counts) - counts) // size


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest_code(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, probe: int) -> list[int]:
    """Cells (``i * len(b) + j``) in ascending order of ``a[i] + b[j]`` until they hold ``probe`` entries."""
    p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[p].tolist(), b[q].tolist()
    heap, seen, out, found = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and found < probe:
        _, i, j = heapq.heappop(heap)
        cell = int(p[i]) * len(b) + int(q[j])
        if counts[cell]:
            out.append(cell)
            found += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return out


def in_order(products: np.ndarray) -> np.ndarray:
    """Row sums in the order of the components: the same double wherever it is computed."""
    return np.add.accumulate(products, axis=1)[:, -1]


def by_score() -> F.Column:
    """Descending, what is no number (infinities of both signs met) last."""
    return F.desc(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")))


def near_block(q: np.ndarray, e: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of all pairs that may be among the ``k`` best of their row once they are scored in order.

    A product by matrices differs from one in order by rounding, which grows with the norms, not with the score: all within that of the
    k-th come along. Where a product could overflow, the pairs are scored in order at once.
    """
    k, d = min(k, len(e)), q.shape[1]
    if float(np.abs(q).max(initial=0)) * float(np.abs(e).max(initial=0)) * d > 1e300 or max(np.abs(q).max(initial=0), np.abs(e).max(initial=0)) > 1e150:
        rows, columns = [], []
        for i in range(len(q)):
            with np.errstate(over="ignore", invalid="ignore"):
                score = in_order(q[i] * e)
            best = np.lexsort((cid, -np.where(np.isnan(score), -np.inf, score)))[:k]
            rows.append(np.full(len(best), i))
            columns.append(best)
        return np.concatenate(rows), np.concatenate(columns)
    s = q @ e.T
    kth = np.partition(s, len(e) - k, axis=1)[:, len(e) - k]
    size = np.sqrt((e * e).sum(1))
    slack = 4 * (d + 2) * 2.0**-53 * np.sqrt((q * q).sum(1))[:, None] * (size + size.max())
    return np.nonzero(s >= kth[:, None] - slack)


def best_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows (qid, cid, score) of each query, by score, then id."""
    qid, cid, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((cid, -np.where(np.isnan(score), -np.inf, score), qid))
    qid, cid, score = qid[order], cid[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]])) if len(qid) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(qid)) - np.repeat(start, np.diff(np.append(start, len(qid))))
    return qid[rank < k], cid[rank < k], score[rank < k]


def measured_probe(wanted: DataFrame, placed: DataFrame, made: Index, k: int, recall: float, most: int) -> int:
    """The entries a walk has to meet for the wanted share of true neighbours, on at most ``most`` queries.

    Every third one of half as many again sets nothing: what such a walk finds of theirs is logged as the held-out recall.
    """
    q = bounded_sample(wanted, "cid", most + most // 2).select("v").toArrow().column(0).combine_chunks()
    if not len(q):
        return 1
    q, scale = matrix(q), made.scale
    schema = arrow_schema("query int, score double, cell int")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = (q * scale) @ (matrix(batch.column("v")) * scale).T
            top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            row = np.repeat(np.arange(len(q)), top.shape[1])
            cells = batch.column("cell").to_numpy()[top.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(s[row, top.ravel()]), pa.array(cells)], schema=schema)

    best = Window.partitionBy("query").orderBy(F.desc("score"))
    near = placed.mapInArrow(compare, "query int, score double, cell int").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).collect()
    a, b = made.sums(q)
    need, held_out = [], []
    for i in range(len(q)):
        order = np.argsort((a[i][:, None] + b[i][None, :]).ravel(), kind="stable")
        met = np.empty(len(order), dtype=np.int64)
        met[order] = np.cumsum(made.counts[order])
        (held_out if i % 3 == 2 else need).extend(int(met[r["cell"]]) for r in near if r["query"] == i)
    probe = max(1, int(np.quantile(need, recall, method="higher"))) if need else 1
    share, found = probe / max(1, int(made.counts.sum())), float(np.mean(np.array(held_out) <= probe)) if held_out else 1.0
    made.met, made.recall = share, found
    logging.getLogger(__name__).log(logging.WARNING if found < 0.9 or share > 0.25 and made.counts.sum() > 100_000 else logging.INFO, "walks meet %.0f %% of the entries; held-out recall %.3f", 100 * share, found)
    return probe


class Index:
    """Codebooks, cell counts and the stored table of placed entries (``cid, v, region``)."""

    def __init__(self, index: DataFrame, cell: int, codes: int | None, sample: int, region: int):
        size = index.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
        n, most = size["n"], float(size["most"] or 1.0)
        self.kind = dict(index.dtypes)["v"]
        self.scale = scale = 2.0 ** -int(np.log2(most)) if most > 1e100 else 1.0  # so that no product of two overflows
        codes = codes or max(4, round((n / cell) ** 0.5))
        x = matrix(bounded_sample(index.select("cid", "v"), "cid", max(sample, 16 * codes)).select("v").toArrow().column(0).combine_chunks()) if n else np.zeros((0, 2))
        x = x * scale
        self.half = half = x.shape[1] // 2 or x.shape[1]
        self.left, self.right = left, right = codebook(x[:, :half], codes), codebook(x[:, half:], codes)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix(batch.column("v")) * scale
                cells = nearest_code(m[:, :half], left) * len(right) + nearest_code(m[:, half:], right) if len(m) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("v"), pa.array(cells.astype(np.int32))], names=["cid", "v", "cell"])

        self.placed = materialize(index.select("cid", "v").mapInArrow(assign, f"cid long, v {self.kind}, cell int"), "cells")
        self.counts = np.zeros(max(1, len(left) * len(right)), dtype=np.int64)
        for r in self.placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one number a cell
            self.counts[r["cell"]] = r["n"]
        self.region = regions(self.counts, region)

    def sums(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the walks of some queries sort by: negative inner products with both codebooks."""
        m = m * self.scale
        return -(m[:, : self.half] @ self.left.T), -(m[:, self.half :] @ self.right.T)


def search(vectors: DataFrame, every: int = 20, k: int = 20, probe: int | None = None, recall: float = 0.97, sample: int = 20_000, cell: int = 256, codes: int | None = None, region: int = 1024, block: int = 1024, chunk: int = 256, judges: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    rows = materialize(usable(vectors), "vectors")
    index = materialize(entries(rows, k), "entries")
    made = Index(index, cell, codes, sample, region)
    placed, counts = made.placed, made.counts

    # a vector that over a thousandth of the queries share is one of at most a thousand: these are broadcast
    own = rows.where(F.col("vec_id") % every == 0)
    common = own.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") * 1000 > own.count()).select("v")
    common = materialize(common.join(index.select("v", "cid"), "v").select("v", F.col("cid").alias("qid")), "common")
    rare = own.join(F.broadcast(common), "v", "left_anti").join(index.select("v", F.col("cid").alias("qid")), "v")
    asked = own.join(F.broadcast(common), "v").select(F.col("vec_id").alias("query_id"), "qid", F.lit(True).alias("common"))
    asked = materialize(asked.unionByName(rare.select(F.col("vec_id").alias("query_id"), "qid", F.lit(False).alias("common"))), "asked")
    wanted = index.select("cid", "v").join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi")

    if probe is None:
        probe = measured_probe(wanted, placed, made, k, recall, judges)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = made_sums(matrix(part.column("v")))
                met = [np.unique(region_of[walk(a[i], b[i], counts, probe)]) for i in range(part.num_rows)]
                which = pa.array(np.repeat(np.arange(len(met)), [len(c) for c in met]))
                flat = np.concatenate(met) if met else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column("cid").take(which), part.column("v").take(which), pa.array(flat.astype(np.int64))], names=["qid", "q", "region"])

    half, left, right, region_of, scale = made.half, made.left, made.right, made.region, made.scale

    def made_sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = m * scale
        return -(m[:, :half] @ left.T), -(m[:, half:] @ right.T)

    visits = materialize(wanted.mapInArrow(visit, f"qid long, q {made.kind}, region long"), "visits")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("v"), pa.array(region_of[batch.column("cell").to_numpy()])], names=["cid", "v", "region"])

    has = placed.mapInArrow(settle, f"cid long, v {made.kind}, region long")

    per = has.groupBy("region").agg(F.count("*").alias("n"))  # one number a region
    slots = per.select("region", F.ceil(F.col("n") / block).cast("long").alias("slots"))

    def packed(df: DataFrame, key: str, vector: str, slot: F.Column, name: str) -> DataFrame:
        return df.select("region", slot.alias("slot"), key, vector).groupBy("region", "slot").agg(F.collect_list(F.struct(key, vector)).alias(name))

    # a region's entries are dealt to slots, and each block of queries goes to each of them: crowded regions are many tasks
    held_by = packed(has.join(slots, "region"), "cid", "v", F.pmod(F.xxhash64("cid"), F.col("slots")), "has")
    turns = visits.groupBy("region").agg(F.ceil(F.count("*") / chunk).alias("turns"))
    asking = packed(visits.join(turns, "region"), "qid", "q", F.pmod(F.xxhash64("qid"), F.col("turns")), "asks").drop("slot")
    asking = asking.join(slots, "region").select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "asks")
    pairs = asking.join(held_by, ["region", "slot"])
    schema = arrow_schema("qid long, cid long, score double")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            for i in range(batch.num_rows):
                asks, has = batch.column("asks")[i].values, batch.column("has")[i].values
                q, e = matrix(asks.field("q")), matrix(has.field("v"))
                qid, cid = asks.field("qid").to_numpy(zero_copy_only=False), has.field("cid").to_numpy(zero_copy_only=False)
                a, b = near_block(q, e, cid, k + 1)
                with np.errstate(over="ignore", invalid="ignore"):
                    held.append((qid[a], cid[b], in_order(q[a] * e[b])))
                rows += len(a)
                if rows > 400_000:  # a task keeps the best of each query over all its blocks, in bounded memory
                    held = [best_of(held, k + 1)]
                    rows = len(held[0][0])
                    if rows > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema=schema)
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best_of(held, k + 1)], schema=schema)

    scored = pairs.select("asks", "has").mapInArrow(rerank, "qid long, cid long, score double")
    best = Window.partitionBy("qid").orderBy(by_score(), "cid")
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("qid", "cid", "score")
    named = top.join(index.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    short = Window.partitionBy("qid").orderBy(by_score(), "vec_id")
    named = named.withColumn("r", F.row_number().over(short)).where(F.col("r") <= k + 1).drop("r")
    last = Window.partitionBy("query_id").orderBy(by_score(), "vec_id")
    few = named.join(F.broadcast(common.select("qid")), "qid", "left_semi")  # at most k + 1 rows for each of a thousand
    every_one = asked.where("NOT common").join(named, "qid").unionByName(asked.where("common").join(F.broadcast(few), "qid"))
    out = every_one.where("query_id <> vec_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
