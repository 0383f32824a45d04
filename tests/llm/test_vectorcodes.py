"""Codes, errors and codebooks against a plain loop over Python integers."""

import hashlib
import math
import random

import pytest

pytest.importorskip("weftmill.llm")
from weftmill.llm import vectorcodes  # noqa: E402

TOP = 2**63 - 1


def brute(rows, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    ints = [[math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x) for x in v] + [0] * (4 * width - len(v)) for _, v, _ in kept]
    parts = [[v[j * width : (j + 1) * width] for v in ints] for j in range(4)]
    books = [p[:256] for p in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for j in range(4):
            groups = {}
            for x in parts[j]:
                groups.setdefault(nearest(x, books[j])[1], []).append(x)
            books[j] = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[j])]
    found = [[nearest(parts[j][n], books[j]) for j in range(4)] for n in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + min(e, TOP)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), min(e, TOP), min(labels[r[2]], TOP), sha) for r, f, e in zip(kept, found, errors, strict=True)), key=repr)


def got(spark, rows, kind="double"):
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], f"vec_id long, embedding array<{kind}>, label int, code string, part int").repartition(5)
    return sorted((tuple(r) for r in vectorcodes.compress(df).collect()), key=repr)


def test_against_a_loop(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(330)]
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(base)] + [(1000 + i, base[5], 9) for i in range(40)] + [(3, base[4], 1), (3, base[4], 1), (None, base[6], None)]
    odd = [(2, None, 1), (4, [None] + [0.1] * 7, 1), (5, [float("nan")] * 8, 1), (6, [float("-inf")] * 8, 1)]
    assert got(spark, rows + odd) == brute(rows)


def test_few_and_uneven_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [], 1)]) == brute([(1, [], 1)])
    rows = [(i, [0.25 * i, -1.0, 3.5, 0.0, 2.0][: i % 6], 1) for i in range(40)]
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 9, 20, 38]) for _ in range(4)], i % 2) for i in range(300)]
    assert got(spark, rows) == brute(rows)
    near = [(i, [2.0**40 + rng.randrange(9) / 8 for _ in range(4)], 0) for i in range(290)]
    assert got(spark, near) == brute(near)
    huge = [(i, [1e306 * (i - 2), 1.0, 0.0, 0.0], 0) for i in range(5)]
    assert got(spark, huge) == brute(huge)


def test_annulus_holds_the_nearest_and_ties_take_the_lowest_index():
    import numpy as np

    rng = np.random.default_rng(1)
    entries = rng.integers(-40, 40, (256, 4)).astype(float)
    entries[17], entries[200] = entries[3], entries[90]
    x = rng.integers(-60, 60, (3000, 4)).astype(float)
    codes, far = vectorcodes.Codebook(entries, True).nearest(x)
    d = ((x[:, None] - entries) ** 2).sum(2)
    assert (codes == d.argmin(1)).all() and (far == d.min(1)).all()
    codes, far = vectorcodes.Codebook(entries.astype(int).astype(object), False).nearest(x[:300].astype(int).astype(object))
    assert (codes == d[:300].argmin(1)).all() and (far == d[:300].min(1)).all()
