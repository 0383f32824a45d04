"""Vector code compression: four codebooks of 256 integer entries, fitted in rounds, searched by annular norm pruning.

A vector becomes integers ``floor(1024 * x)``, cut into four parts. A part's nearest entry is found among its codebook
sorted by norm: the entries next to the part's own norm give a first distance ``r``, and by the triangle inequality no
entry whose norm is further than ``r`` from the part's can be nearer, so a binary search gives the annulus of norms
``[|x| - r, |x| + r]``, both ends included, and only that is evaluated, in exact integer arithmetic. Parts are taken in
blocks sorted by norm, so a block's annuli are nearly one slice of the sorted codebook and one matrix product.

One round is one scan: every task adds up the parts of its rows by entry, so at most 4 * 256 rows of sums leave a task
however the rows lie, Spark adds those, and the driver holds the codebooks alone (4 * 256 entries). No row is exchanged
but for the sums by label, which have a map-side part; the join with them is an equi-join that adaptive execution splits
where one label holds much of the table. Codes are written once as a scratch table, so a lost executor costs its tasks.

Exactness: components are doubles below 2**53 where ``width * (2 * largest)**2`` fits there, which holds up to |x| of
some thousands; beyond, the same search runs on Python integers. Sums travel as 32-bit limbs, as many as the largest
component and the row count can need.

Defined edge cases: vectors that are null or hold null or non-finite components take no part; a null vec_id sorts last
for the first codebook, equal vec_ids are ordered by vector and are rows of their own; fewer than 256 rows give as many
entries; shorter vectors are read as ending in zeros up to the longest, rounded up to four equal parts; an empty vector
is all zeros; errors beyond a long are the largest long; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftmill.llm.common import materialize, scratch_root

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LONG_MAX = 2**63 - 1
_BLOCK, _RING = 128, 8
_LIMB = 32


class Codebook:
    """The entries of one part, sorted by norm for the search; ``entries`` keeps their own order."""

    def __init__(self, entries: np.ndarray, exact: bool):
        self.entries, self.exact = entries, exact
        squares = (entries * entries).sum(1) if entries.shape[1] else np.zeros(len(entries), entries.dtype)
        self.by = np.argsort(squares, kind="stable")
        self.sorted, self.squares = entries[self.by], squares[self.by]
        self.norms = np.sqrt(self.squares) if exact else [math.isqrt(int(s)) for s in self.squares]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, the lowest index of equals."""
        return self._doubles(x) if self.exact else self._integers(x)

    def _doubles(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, far = np.empty(len(x), np.int64), np.empty(len(x))
        squares = (x * x).sum(1)
        norms = np.sqrt(squares)
        rows = np.argsort(norms, kind="stable")
        for a in range(0, len(x), _BLOCK):
            at = rows[a : a + _BLOCK]
            q, qs, qn = x[at], squares[at], norms[at]
            middle = int(np.searchsorted(self.norms, qn[len(at) // 2]))
            r = np.sqrt(self._distances(q, qs, max(0, min(middle, len(self.by) - 1) - _RING), middle + _RING).min(1))
            slack = 1e-9 * (1 + qn + r)  # roots are rounded; a wider annulus costs nothing but an entry
            low = int(np.searchsorted(self.norms, (qn - r - slack).min(), "left"))
            high = int(np.searchsorted(self.norms, (qn + r + slack).max(), "right"))
            d = self._distances(q, qs, low, high)
            far[at] = d.min(1)
            codes[at] = np.where(d == far[at][:, None], self.by[low:high], len(self.by)).min(1)
        return codes, far

    def _distances(self, q: np.ndarray, qs: np.ndarray, low: int, high: int) -> np.ndarray:
        return qs[:, None] + self.squares[low:high] - 2 * (q @ self.sorted[low:high].T)

    def _integers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, far = np.empty(len(x), np.int64), np.empty(len(x), object)
        for i, q in enumerate(x):
            norm = math.isqrt(int((q * q).sum()))

            def best(low: int, high: int, q=q) -> tuple[int, int]:
                return min((int(((c - q) ** 2).sum()), int(b)) for c, b in zip(self.sorted[low:high], self.by[low:high], strict=True))

            at = min(bisect_left(self.norms, norm), len(self.by) - 1)
            r = math.isqrt(best(at, at + 1)[0]) + 1  # roots are rounded down
            far[i], codes[i] = best(bisect_left(self.norms, norm - r - 1), bisect_right(self.norms, norm + r + 1))
        return codes, far


class Shape:
    """What all rows share: width of a part, whether doubles are exact, limbs of a sum."""

    def __init__(self, longest: int, largest: float, rows: int):
        self.width = -(-longest // PARTS)
        top = int(largest) * SCALE + SCALE
        self.exact = self.width * (2 * top) ** 2 < 2**53
        self.limbs = max(1, -(-(top.bit_length() + rows.bit_length() + 1) // (_LIMB - 1))) if top * rows >= 2**62 else 1

    def integers(self, column: pa.Array) -> np.ndarray:
        """``(rows, PARTS, width)``: doubles that hold integers, or Python integers."""
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(ends)
        values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        flat = np.zeros((len(lists), PARTS * self.width), np.float64 if self.exact else object)
        if self.exact:
            cells = np.floor(SCALE * values)
        else:
            cells = np.array([math.floor(SCALE * v) if abs(v) < 2**900 else SCALE * int(v) for v in values.tolist()] or [], object)
            flat[:] = 0
        row = np.repeat(np.arange(len(lists)), sizes)
        flat[row, np.arange(len(cells)) - np.repeat(ends[:-1] - ends[0], sizes)] = cells
        return flat.reshape(len(lists), PARTS, self.width)

    def split(self, value: int) -> list[int]:
        """A sum as limbs, lowest first; the highest carries the sign."""
        out = []
        for _ in range(self.limbs - 1):
            out.append(value & (2**_LIMB - 1))
            value >>= _LIMB
        return [*out, value]

    @staticmethod
    def join(limbs: list[int]) -> int:
        return sum(v << (_LIMB * i) for i, v in enumerate(limbs))


def _round_sums(rows: DataFrame, shape: Shape, books: list[Codebook]) -> list:
    """``(part, entry, n, sums)`` of all rows under ``books``."""
    schema = to_arrow_schema(T._parse_datatype_string(ddl := "part int, entry int, n long, sums array<long>"))
    width, limbs = shape.width, shape.limbs

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(books[0].by)
        sums = np.zeros((PARTS, size, width), np.int64 if shape.exact else object)
        counts = np.zeros((PARTS, size), np.int64)
        for batch in batches:
            x = shape.integers(batch.column("embedding"))
            for j, book in enumerate(books):
                codes, _ = book.nearest(np.ascontiguousarray(x[:, j]))
                np.add.at(sums[j], codes, x[:, j].astype(sums.dtype))
                counts[j] += np.bincount(codes, minlength=size)
        part, entry = np.nonzero(counts)
        cells = [[v for s in sums[j, i].tolist() for v in shape.split(s)] for j, i in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(cells, pa.list_(pa.int64())).cast(schema.field("sums").type)], schema=schema)

    partial = rows.select("embedding").mapInArrow(add, ddl)
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width * limbs)]
    return [(r.part, r.entry, r.n, list(r[3:])) for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()]


def fit(rows: DataFrame, shape: Shape, rounds: int = ROUNDS) -> list[Codebook]:
    """The codebooks after ``rounds`` rounds over all ``rows`` (clean ones); the first entries are those of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow()
    start = shape.integers(first.column("embedding"))
    books = [Codebook(np.ascontiguousarray(start[:, j]), shape.exact) for j in range(PARTS)]
    for _ in range(rounds):
        entries = [b.entries.copy() for b in books]
        for part, entry, n, limbs in _round_sums(rows, shape, books):
            k = shape.limbs
            entries[part][entry] = [shape.join(limbs[i : i + k]) // n for i in range(0, len(limbs), k)]
        books = [Codebook(e, shape.exact) for e in entries]
    return books


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b.entries for v in e).encode()).hexdigest()


def clean(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("embedding").isNotNull() & finite)


def encode(rows: DataFrame, shape: Shape, books: list[Codebook]) -> DataFrame:
    """``vec_id, label, code, error`` of clean rows."""
    out = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shape.integers(batch.column("embedding"))
            found = [b.nearest(np.ascontiguousarray(x[:, j])) for j, b in enumerate(books)] if len(x) else []
            codes = np.array([c for c, _ in found], np.uint8).T
            errors = sum(d for _, d in found) if found else []
            columns = [batch.column("vec_id"), batch.column("label"), [bytes(c).hex() for c in codes], [min(int(e), LONG_MAX) for e in errors]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, out)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that takes part."""
    scratch_root(vectors.sparkSession)
    rows = clean(vectors)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("longest"), F.coalesce(F.max(F.array_max(F.transform("embedding", F.abs))), F.lit(0.0)).alias("largest")).first()
    shape = Shape(size.longest, size.largest, size.n)
    books = fit(rows, shape, rounds) if size.n else [Codebook(np.zeros((0, 0)), True)] * PARTS
    coded = materialize(encode(rows, shape, books), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
