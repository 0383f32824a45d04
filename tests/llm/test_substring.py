"""Repeated windows against brute force, and the consistency of the renaming."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("weftmill.llm")
from weftmill.llm import substring  # noqa: E402


def brute(rows, width=13):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = {p for i in range(len(w) - width + 1) if d is not None and least[tuple(w[i : i + width])] < d for p in range(i, i + width)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["a", "a", "Ä", "b"]
    pool = [" ".join(rng.choice(words, 60)) for _ in range(6)] + ["a " * 40, "x y " * 30, ("r " * 15 + "s ") * 4]
    rows = [(None, pool[0]), (50, None), (51, ""), (52, "few words"), (53, pool[0]), (53, pool[0]), (2, pool[6]), (9, pool[6] + pool[7])]
    for d in range(60):
        part = []
        for _ in range(int(rng.integers(1, 5))):
            p = pool[int(rng.integers(0, len(pool)))].split()
            a = int(rng.integers(0, len(p)))
            part += p[a : a + int(rng.integers(1, 40))]
            part += list(rng.choice(words, int(rng.integers(0, 20))))
        rows.append((d + 60, " \n".join(part)))
    return rows


@pytest.mark.parametrize("rounds", [1, 2])
def test_against_brute_force(spark, rounds):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as name", "2 as h")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(df, rounds=rounds).collect()), key=repr)
    assert got == brute(rows)
    texts = {r.doc_id: r.text for r in substring.deduplicate(df, rounds=rounds).collect()}
    assert texts[50] == "" and texts[52] == "few words"


def test_empty_table(spark):
    assert substring.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_choose_equal_names():
    rng = np.random.default_rng(11)
    for rounds in (1, 2, 3):
        core = rng.integers(0, 9, 13).astype(np.uint64)
        seen = set()
        for _ in range(30):
            left, right = rng.integers(0, 9, int(rng.integers(0, 20))).astype(np.uint64), rng.integers(0, 9, int(rng.integers(0, 20))).astype(np.uint64)
            s = np.concatenate([left, core, right])
            seen.add(int(substring.choices(s, np.array([len(left)]), 13, rounds)[0]))
        assert len(seen) == 1


def test_many_wholly_equal_rows_and_a_very_long_text(spark):
    text = " ".join(f"u{i}" for i in range(30))
    same = spark.range(1_000_000).selectExpr("7L AS doc_id", f"'{text}' AS text")
    long = " ".join(f"v{i % 977}x{i % 1013}" for i in range(300_000))
    others = [(3, "lead " + text), (9, long), (11, " ".join(long.split()[150_000:150_040])), (12, None), (12, None)]
    out = substring.report(same.unionByName(spark.createDataFrame(others, "doc_id long, text string"))).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    got = {(r.doc_id, r.n_words, r.n_removed): (r.kept_sha256, r["count"]) for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {(7, 30, 30): (empty, 1_000_000), (3, 31, 0): (hashlib.sha256(("lead " + text).encode()).hexdigest(), 1), (9, 300_000, 0): (hashlib.sha256(long.encode()).hexdigest(), 1), (11, 40, 40): (empty, 1), (12, 0, 0): (empty, 2)}
