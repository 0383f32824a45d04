"""Shares and taken words against a plain queue, and what any mix must hold."""

import hashlib
import re
from fractions import Fraction

import pytest

pytest.importorskip("weftmill.llm")
from weftmill.llm import mixing  # noqa: E402


def shares(sizes, weights=(1, 2, 3), most=3):
    """Exact targets by sharing again one round at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(out.values())
        w = sum(weight[s] for s in open_) or 1
        above = {s for s in open_ if Fraction(weight[s] * left, w) > most * sizes[s]}
        if not above:
            return {**out, **{s: Fraction(weight[s] * left, w) for s in open_}}
        out |= {s: Fraction(most * sizes[s]) for s in above}
        open_ -= above


def brute(rows, group=32):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    target = shares(sizes)
    queue, taken = [], {}
    for s, whole in sizes.items():
        own = {}
        for d, o, n in sized:
            if o == s and n:
                own[d, n] = own.get((d, n), 0) + 1
        place = {d: int(hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()[:15], 16) for d, _ in own}
        at = 0
        for (d, n), count in sorted(own.items(), key=lambda x: (place[x[0][0]], x[0][0] is not None, x[0][0] or 0, x[0][1])):
            for first in range(0, count, group):
                copies = min(group, count - first)
                for p in range(3):
                    begin = at + p * whole
                    if begin < target[s]:
                        queue.append((float(begin + copies * n) / float(target[s]), place[d], s is None, s or "", d is not None, d or 0, n, first, p, copies))
                at += copies * n
    left = sum(sizes.values())
    for _, _, null, s, known, d, n, first, _, copies in sorted(queue):
        for k in range(copies):
            got = min(n, left)
            left -= got
            key = (d if known else None, None if null else s, n, first + k)
            taken[key] = taken.get(key, 0) + got
    seen, out = {}, []
    for d, s, n in sized:
        k = seen[d, s, n] = seen.get((d, s, n), -1) + 1
        out.append((d, n, sizes[s], float(target[s]), taken.get((d, s, n, k), 0)))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, s, 9, 9.5) for d, t, s in rows], "doc_id long, text string, source string, size int, target double").repartition(3)
    return sorted((tuple(r) for r in mixing.mix(df).collect()), key=repr)


def docs(n=400):
    rows = []
    for i in range(n):
        words = (i * 7919) % 23
        source = None if i % 29 == 0 else "hot" if i % 3 else f"s{i % 5}"
        rows.append((i, None if i % 31 == 0 else " \t".join(["w"] * words) if i % 37 else "", source))
    return rows


def test_against_a_queue(spark):
    odd = [(7, "a b c", "hot"), (7, "a b c", "hot"), (7, "a b", "hot"), (None, "x y z", None), (None, None, None)] + [(None, "k l m n", "s1")] * 75 + [(5, "", "none")] * 70 + [(900, "é ü w\x0bv", "Ωmega"), (901, "long " * 3000, "long")]
    rows = docs() + odd
    result = got(spark, rows)
    assert result == brute(rows) and sum(r[4] for r in result) == sum(r[1] for r in result)
    assert all(0 <= r[4] <= 3 * r[1] for r in result) and got(spark, rows[::-1]) == result


def test_few_rows(spark):
    assert got(spark, []) == []
    for rows in ([(1, None, None)], [(1, "a b", "x")], [(1, "a", "x"), (2, "b " * 50, "y"), (3, "", "z")]):
        assert got(spark, rows) == brute(rows)


def test_running_sums_over_small_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k long, v long")
    rows = mixing.running(df, [mixing.F.col("k")], ["v"], "t", share=9).orderBy("k").collect()
    total = 0
    for r in rows:
        total += r.v
        assert r.v_upto == total


def test_every_source_comes_near_its_target(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(df)
    largest = out.agg({"size": "max"}).first()[0]
    by = df.select("doc_id", "source").join(out, "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= largest for r in by)
