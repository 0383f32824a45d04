"""Hierarchical multi-length packing of documents into windows of several context sizes.

Each task encodes its documents and packs them in rounds of about ``round_tokens`` ids, so nothing is shuffled and a
worker's memory is bounded. Of a document, whole 1024-id windows go out as they are; the rest is routed to the tier
(1024, 512, 256 or 128) that just holds it. Tiers are packed from the longest: the longest piece opens a window of its
tier, and the gap is filled from the shorter tiers, best fit first; when nothing fits, a shorter piece is cut to fill
it exactly. What a round can't fill is carried into the next; at the end of a task what is left goes into ever shorter tiers,
and the last ids, fewer than the shortest tier holds, are one window of 1024, the only one of a task that is padded.

Step groups: the windows of one tier in a round are dealt to steps of ``step_tokens`` ids in serpentine order of their
attention cost (the sum of squared piece lengths), so steps have equal shape and nearly equal cost.

Defined edge cases: a null or empty text is its end id alone; a null doc_id is kept; repeated rows are packed each; an
empty table gives no rows; other columns are left alone. Sequence ids hold the task's number, so they are unique, and
a repeated attempt of a task gives the same ones.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftmill.llm.common import arrow_schema, slices, texts
from weftmill.llm.tokens import encoder

TIERS = (128, 256, 512, 1024)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_id long"


class Packer:
    """Packs pieces ``(length, doc, start)`` into windows, whatever their ids."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = tiers, tiers[-1]
        self.pieces: list[tuple[int, int, int]] = []  # (length, doc, start), ascending
        self.left = 0
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, tokens: int) -> None:
        whole = tokens - tokens % self.longest
        for start in range(0, whole, self.longest):
            self.windows.append((self.longest, [(self.longest, doc, start)]))
        if tokens > whole:
            insort(self.pieces, (tokens - whole, doc, whole))
            self.left += tokens - whole

    def _fill(self, size: int, window: list[tuple[int, int, int]]) -> None:
        gap = size - sum(p[0] for p in window)
        while gap:
            at = bisect_right(self.pieces, (gap, 1 << 62, 0))
            if at:
                piece = self.pieces.pop(at - 1)
            else:  # nothing fits whole: cut the shortest
                length, doc, start = self.pieces.pop(0)
                piece = (gap, doc, start)
                insort(self.pieces, (length - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
            self.left -= piece[0]
        self.windows.append((size, window))

    def pack(self, last: bool) -> None:
        """Fill windows as long as there is enough left to fill one; at the last round, down to nothing."""
        while self.pieces:
            piece = self.pieces[-1]
            size = next(t for t in self.tiers if t >= piece[0])
            if self.left >= size and (last or self.left >= 4 * self.longest):
                self.pieces.pop()
                self.left -= piece[0]
                self._fill(size, [piece])
            elif last and self.left >= self.tiers[0]:
                self._fill(next(t for t in reversed(self.tiers) if t <= self.left), [])
            elif last:
                self.windows.append((self.longest, self.pieces[::-1]))
                self.pieces, self.left = [], 0
            else:
                break


def deal(windows: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """The step of each window within its round: serpentine by cost within a tier."""
    steps = [0] * len(windows)
    base = 0
    for tier in sorted({w[0] for w in windows}, reverse=True):
        mine = sorted((i for i, w in enumerate(windows) if w[0] == tier), key=lambda i: (-sum(p[0] ** 2 for p in windows[i][1]), i))
        n = -(-len(mine) // max(1, step_tokens // tier))
        for rank, i in enumerate(mine):
            turn, at = divmod(rank, n)
            steps[i] = base + (at if turn % 2 == 0 else n - 1 - at)
        base += n
    return steps


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, tokenizer_path: str | None = None, step_tokens: int = 1 << 15, round_tokens: int = 1 << 20) -> DataFrame:
    """One row for each piece: where it comes from, where it goes, and the checksum of its ids."""
    schema = arrow_schema(DDL)
    tail = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        packer, held, fresh, number, sequence, step = Packer(), {}, 0, 0, task << 36, task << 36

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, step
            packer.pack(last)
            out: list[list] = [[] for _ in schema.names]
            steps = deal(packer.windows, step_tokens)
            for (size, window), at in zip(packer.windows, steps, strict=True):
                offset = 0
                for length, doc, start in window:
                    doc_id, ids = held[doc]
                    for column, v in zip(out, (doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), sequence, offset, size, step + at), strict=True):
                        column.append(v)
                    offset += length
                sequence += 1
            step += max(steps, default=-1) + 1
            packer.windows = []
            keep = {p[1] for p in packer.pieces}
            for k in [k for k in held if k not in keep]:
                del held[k]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        for batch in slices(batches):
            encoded = encoder(tokenizer, tokenizer_path).encode_batch(batch.column("text").to_pylist())
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids = np.frombuffer(raw + tail, dtype="<u2").astype("<u4")
                held[number] = (doc_id, ids)
                packer.add(number, len(ids))
                number += 1
                fresh += len(ids)
                if fresh >= round_tokens:
                    fresh = 0
                    yield from emit(False)
        yield from emit(True)

    return texts(docs).mapInArrow(run, DDL)
