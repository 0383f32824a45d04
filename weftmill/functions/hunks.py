"""Line diffs as hunks: a least edit script grouped into changed regions with ``@@`` headers.

Equal lines at both ends are set aside. The script of the middle is the one that a whole table of common-subsequence lengths would
give, where deletions come first if neither choice is longer, for texts of any length. Instead of the table there are frontiers: from
the end of both texts, how far ``d`` edits reach on each diagonal. They say of any place whether it is at most ``d`` edits from the
end, which is all that the walk from the start asks. Lines that only one text has cost no edit in them, so time is the number
of common lines by the number of edits between these. Frontiers are kept up to ``cells`` numbers; those of more edits are made again by halves
as the walk comes to them, so memory does not grow with their square, and the script is the same.

A null text is an empty one, ``\\r\\n`` is ``\\n``, an empty text is one empty line, line numbers start at 1.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_HEADING = re.compile(r"#{1,6}\s")
HUNK = T.StructType().add("before_start", "integer").add("after_start", "integer").add("before_lines", T.ArrayType(T.StringType())).add("after_lines", T.ArrayType(T.StringType()))
DIFF = T.StructType().add("changed", "boolean").add("hunks", T.ArrayType(HUNK)).add("unified", "string").add("added", "integer").add("removed", "integer").add("structural", "boolean")


class _Frontiers:
    """For ``d`` = 0, 1, ...: the least diagonal and, for every second one from there, the furthest place in ``p`` that ``d`` edits between ``p`` and ``q`` reach."""

    def __init__(self, p: np.ndarray, q: np.ndarray, cells: int):
        self.n, self.m, self.cells = len(p), len(q), cells
        self.p, self.q = np.append(p, -1), np.append(q, -2)  # ends equal nothing
        self.rows, held = [(0, self._slide(np.zeros(1, np.int64), np.zeros(1, np.int64)))], 1
        row, self.edits = self.rows[0], 0
        while not self.reached(row, self.n, self.m):
            row, self.edits = self._next(row), self.edits + 1
            held += len(row[1])
            if held <= cells:
                self.rows.append(row)

    @staticmethod
    def reached(row: tuple[int, np.ndarray], x: int, y: int) -> bool:
        at, odd = divmod(x - y - row[0], 2)
        return not odd and 0 <= at < len(row[1]) and row[1][at] >= x

    def _slide(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Places moved on over equal elements, looked at in blocks that double."""
        at, width = np.flatnonzero(self.p[x] == self.q[x - k]), 4
        while len(at):
            step = np.arange(width)
            equal = self.p[np.minimum(x[at, None] + step, self.n)] == self.q[np.minimum((x - k)[at, None] + step, self.m)]
            run = np.where(equal.all(1), width, equal.argmin(1))
            x[at] += run
            at = at[run == width]
            width = min(2 * width, max(4, 2**18 // max(1, len(at))))
        return x

    def _next(self, row: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        low, x = row
        high = low + 2 * len(x) - 2
        first, last = low - 1 if low > -self.m else low + 1, high + 1 if high < self.n else high - 1
        k = np.arange(first, last + 1, 2)
        by = np.concatenate(([-2], x, [-2]))  # diagonals low - 2 to high + 2
        left, right = by[(first - low + 1) // 2 :][: len(k)], by[(first - low + 3) // 2 :][: len(k)]
        return first, self._slide(np.minimum(np.maximum(left + 1, right), np.minimum(self.n, self.m + k)), k)

    def down(self):
        """Frontiers from that of one edit less than all to that of none."""
        yield from self._between(self.rows[-1], len(self.rows), self.edits - 1)
        yield from reversed(self.rows[: self.edits])

    def _between(self, row: tuple[int, np.ndarray], first: int, last: int):
        """Frontiers ``last`` to ``first``, where ``row`` is the one before ``first``."""
        if first > last:
            return
        if first == last or (last - first + 1) * min(last + 1, self.n + self.m + 1) <= self.cells:
            rows = []
            for _ in range(first, last + 1):
                rows.append(row := self._next(row))
            yield from reversed(rows)
            return
        middle, half = (first + last) // 2, row
        for _ in range(first, middle + 1):
            half = self._next(half)
        yield from self._between(half, middle + 1, last)
        yield from self._between(row, first, middle)


def script(x: list[str], y: list[str], cells: int = 4_000_000) -> list[str]:
    """``" "``, ``"-"``, ``"+"`` for each step from ``x`` to ``y``; ``cells`` numbers are kept at most, which changes nothing else."""
    names = {s: i for i, s in enumerate(dict.fromkeys(x + y))}
    common = set(x) & set(y)
    ends = _Frontiers(*(np.array([names[s] for s in reversed(t) if s in common], np.int64) for t in (x, y)), cells)
    p, q, rows = ends.n, ends.m, ends.down()
    nearer = next(rows, None)  # what one edit less reaches
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(" ")
            i, j, p, q = i + 1, j + 1, p - 1, q - 1
        elif x[i] not in common:
            out.append("-")
            i += 1
        else:
            less = nearer is not None and ends.reached(nearer, p - 1, q)
            out.append("-" if less else "+")
            if less or y[j] in common:
                nearer = next(rows, None)
            if less:
                i, p = i + 1, p - 1
            else:
                j, q = j + 1, q - (y[j] in common)
    return out + ["-"] * (len(x) - i) + ["+"] * (len(y) - j)


def line_hunks(before: str | None, after: str | None) -> tuple:
    """``changed, hunks, unified, added, removed, structural`` of two texts."""
    a, b = ((t or "").replace("\r\n", "\n").split("\n") for t in (before, after))
    lead = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    tail = next((i for i, (p, q) in enumerate(zip(a[lead:][::-1], b[lead:][::-1], strict=False)) if p != q), min(len(a), len(b)) - lead)
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    steps = script(x, y)
    hunks: list[tuple] = []
    i, j, open_ = lead, lead, False
    for step in steps:
        if step != " " and not open_:
            hunks.append((i + 1, j + 1, [], []))
        open_ = step != " "
        if step == "-":
            hunks[-1][2].append(a[i])
        elif step == "+":
            hunks[-1][3].append(b[j])
        i, j = i + (step != "+"), j + (step != "-")
    head = lambda h: f"@@ -{h[0]},{len(h[2])} +{h[1]},{len(h[3])} @@"
    unified = "\n".join("\n".join([head(h), *("-" + s for s in h[2]), *("+" + s for s in h[3])]) for h in hunks)
    touched = [s for h in hunks for s in h[2] + h[3]]
    return bool(hunks), hunks, unified, sum(len(h[3]) for h in hunks), sum(len(h[2]) for h in hunks), any(_HEADING.match(s) for s in touched)


def _diffs(before: pa.Array, after: pa.Array, size: int = 64) -> pa.Array:
    """The diffs of a batch; only ``size`` rows of it are Python objects at a time."""
    parts = []
    for at in range(0, max(1, len(before)), size):
        rows = [line_hunks(p, q) for p, q in zip(before.slice(at, size).to_pylist(), after.slice(at, size).to_pylist(), strict=True)]
        parts.append(pa.array([dict(zip(DIFF.names, (r[0], [dict(zip(HUNK.names, h, strict=True)) for h in r[1]], *r[2:]), strict=True)) for r in rows], type=to_arrow_type(DIFF)))
    return pa.concat_arrays(parts)


@F.arrow_udf(DIFF)
def diff_hunks(before: pa.Array, after: pa.Array) -> pa.Array:
    return _diffs(before, after)
