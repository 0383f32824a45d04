"""SimHash near-duplicates: 64-bit fingerprints, linked at two or fewer differing bits by pivot distance tables.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint 0), XXH64 with seed 42; a bit is 1 if set in over half of the hashes.

Linking works on distinct fingerprints (each with its smallest doc_id), so copies cost one row:

1. the 64 bits are cut into ``m`` blocks; a pair within two bits agrees on some ``m - 2`` of them, so every such choice
   is a bucket key and no pair is lost. ``m`` grows with the number of distinct fingerprints, to keep buckets small;
2. the table of Hamming distances to ``PIVOTS`` reference fingerprints is made once for each distinct fingerprint and
   travels with it. In a group, each pair whose largest coordinate difference exceeds two is discarded (triangle
   inequality), and the survivors are verified;
3. a bucket of at most ``most`` fingerprints is one group. A larger one is not compared pairwise: each of its
   fingerprints goes to itself and to its one-bit neighbours, and those that meet are a group. Two fingerprints are within
   two bits exactly if their one-bit balls meet, so no pair is lost, and such a group has at most 65 members.

Links become components by star rounds. Defined edge cases: null and blank texts have fingerprint 0 and link like any
other; a very long text is fingerprinted whole; a null doc_id keeps its row, and its component is the smallest doc_id
there, or null; repeated rows are kept; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmill.llm.common import arrow_schema, materialize, per_text, texts
from weftmill.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    end = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = np.concatenate([[0], end[: -width] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first.tolist(), end[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(first))
    counts = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, h, fp`` (a digest of the text, and the fingerprint as a signed long) of every row."""

    def run(batch) -> dict:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "fp": fp.view(np.int64)}

    return per_text(texts(docs).select("doc_id", "text", F.xxhash64("text").alias("h")), run, "doc_id long, h long, fp long")


def pivots(n: int = 16) -> np.ndarray:
    """Reference fingerprints from a fixed rule (the splitmix64 sequence)."""
    out, x, full = [], 0, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & full
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


PIVOTS = pivots()


def masks(m: int) -> list[int]:
    """Bit masks of every choice of ``m - 2`` out of ``m`` blocks of the 64 bits."""
    edge = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(block[i] for i in keep) for keep in combinations(range(m), m - 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """The Hamming distances of each fingerprint to the reference fingerprints."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def block_links(fp: np.ndarray, node: np.ndarray, group: np.ndarray, table: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one group (rows sorted by group) within ``radius`` bits, as a spanning forest."""
    parent = np.arange(len(fp))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for step in range(1, len(fp)):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        for j in range(table.shape[1]):
            i = i[np.abs(table[i, j] - table[i + step, j]) <= radius]
            if not len(i):
                break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        for k in i.tolist():
            x, y = find(k), find(k + step)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(k)
                b.append(k + step)
    return node[a], node[b]


def links(distinct: DataFrame, radius: int = 2, most: int = 256) -> DataFrame:
    """Links ``a, b`` between the representatives (column ``node``) of the distinct fingerprints ``fp``."""
    if radius != 2:
        raise ValueError("the bucket keys are made for a radius of two bits")
    n = distinct.count()
    m = 3 if n < 1 << 23 else 4 if n < 1 << 33 else 5
    keep = masks(m)
    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column("fp").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("node"), pa.array([t.tobytes() for t in table], type=pa.binary())], names=["fp", "node", "pivots"])

    table = distinct.select("fp", "node").mapInArrow(tabulate, "fp long, node long, pivots binary")
    rows = table.select("fp", "node", "pivots", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(k))).alias("key")) for i, k in enumerate(keep)])).alias("k"))
    rows = rows.select("fp", "node", "pivots", "k.band", "k.key")
    size = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = F.collect_list(F.struct("fp", "node", "pivots")).alias("members")
    sized = rows.join(size, ["band", "key"])
    few = sized.where(F.col("n") <= most).groupBy("band", "key").agg(member)
    balls = F.array(*[F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64) if not k >> i & 1]) for k in keep])
    met = sized.where(F.col("n") > most).select("fp", "node", "pivots", "band", F.explode(F.element_at(balls, F.col("band") + 1)).alias("z"))
    crowded = met.groupBy("band", "z").agg(member).where("size(members) > 1")

    schema = arrow_schema("a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                lists = batch.column(0).slice(at, 2000)
                count = np.array([len(v) for v in lists], dtype=np.int64)
                flat = lists.flatten()
                fp = flat.field("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                known = np.frombuffer(b"".join(flat.field("pivots").to_pylist()), dtype=np.int8).reshape(len(fp), -1)
                a, b = block_links(fp, flat.field("node").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(count)), count), known)
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], schema=schema)

    return few.select("members").unionByName(crowded.select("members")).mapInArrow(compare, "a long, b long").distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, h, fp, component_id`` of every row; ``h`` is a digest of the text."""
    each = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    roots = components(links(distinct.where("node is not null")))
    known = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return each.join(known, "fp").select("doc_id", "h", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return _grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with its smallest doc_id; of several texts with that id, the one with the
    smallest digest, and of wholly equal rows one. Rows without an id stay."""
    first = _grouped(docs).where("doc_id = component_id").groupBy("component_id").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    kept = materialize(first, "kept").select(F.col("component_id").alias("_weftmill_id"), F.col("h").alias("_weftmill_h"), F.col("n").alias("_weftmill_n"))
    marked = docs.withColumn("_weftmill_digest", F.xxhash64("text"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = marked.join(kept.hint("merge"), (F.col("doc_id") == F.col("_weftmill_id")) & (F.col("_weftmill_digest") == F.col("_weftmill_h")))  # the ids grow with the input: the same plan at every size
    one = Window.partitionBy("doc_id").orderBy(*[c for c in own])  # only ids that several rows share are ranked
    several = out.where("_weftmill_n > 1").withColumn("_weftmill_rank", F.row_number().over(one)).where("_weftmill_rank = 1")
    return out.where("_weftmill_n = 1").select(*own).unionByName(several.select(*own)).unionByName(docs.where("doc_id is null"))
