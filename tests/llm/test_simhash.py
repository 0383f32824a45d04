"""Fingerprints and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

pytest.importorskip("weftmill.llm")
from weftmill.llm import simhash  # noqa: E402


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(ids, fps):
    parent = {i: i for i in range(len(ids))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return {d: low[find(i)] for i, d in enumerate(ids)}


def test_fingerprint_matches_definition():
    for t in (None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c", "É é x y z", "word " * 500, "x y z w", "\x1c a b\x0bc d"):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_masks_cover_every_pair():
    for m in (3, 4, 5):
        keep = simhash.masks(m)
        for i in range(64):
            for j in range(64):
                assert any(not (k >> i & 1 or k >> j & 1) for k in keep)


def planted(rng, n):
    base = [int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64)]
    out = []
    for k in range(n):
        x = base[k % 30] if k % 3 else int(rng.integers(0, 1 << 63))
        for b in rng.integers(0, 64, k % 4):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("most", [256, 3])
def test_links_lose_nothing(spark, most):
    from weftmill.llm.components import components

    fps = sorted(set(planted(np.random.default_rng(7), 400)))
    rows = [(simhash.signed(f), i) for i, f in enumerate(fps)]
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(rows, "fp long, node long"), most=most)).collect()}
    assert {i: roots.get(i, i) for i in range(len(fps))} == slow_components(list(range(len(fps))), fps)


def test_near_duplicates_edge_cases(spark):
    rows = [(5, None, 1), (3, "", 2), (9, "  ", 3), (4, "alpha beta gamma delta", 4), (8, "ALPHA beta gamma  delta", 5), (8, "ALPHA beta gamma  delta", 5), (None, "alpha beta gamma delta", 6), (20, "w " * 20000, 7), (None, "lone words here now", 8)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    assert len(out) == 9 and got[(5, "0" * 16)] == got[(3, "0" * 16)] == got[(9, "0" * 16)] == 3
    assert all(got[k] == 4 for k in got if k[1] == format(simhash.fingerprint("alpha beta gamma delta"), "016x"))
    assert got[(None, format(simhash.fingerprint("lone words here now"), "016x"))] is None
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    assert kept.columns == ["doc_id", "text", "fp"] and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 3, 4, 20]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = slow_components([r.doc_id for r in rows], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (format(f, "016x"), want[r.doc_id]) for r, f in zip(rows, fps, strict=True)}
