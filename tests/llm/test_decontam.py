"""Exact windows against brute force; proximity; groups of items."""

import re

import pytest

pytest.importorskip("weftmill.llm")
from weftmill.llm import decontam  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    out = {}
    for d, t in docs:
        w, hit, items = split(t), set(), set()
        for item, b in bench:
            b = split(b)
            if item is None or not b:
                continue
            for a in range(max(1, len(b) - 12)):
                q = b[a : a + 13]
                for i in range(len(w) - len(q) + 1):
                    if w[i : i + len(q)] == q:
                        hit |= set(range(i, i + len(q)))
                        items.add(str(item))
        out[d] = (len(w), len(hit), len(items), decontam.digest(list(items)), bool(hit) and 20 * len(hit) >= len(w))
    return out


LONG = " ".join(f"w{i % 23}x{i % 7}" for i in range(60))
BENCH = [(1, LONG), (2, "short item here"), (3, None), (4, " .. "), (10, "short item here"), (None, "no id at all"), (7, "Éa bç 12ab-cd " * 9), (8, "same " * 20), (8, "same " * 20)]
DOCS = [
    (1, "intro " + " ".join(LONG.split()[5:30]) + " outro"), (2, "SHORT Item, here and short item here"), (3, None), (4, ""), (5, "Éa bç 12ab cd " * 30 + "x y z"), (6, "same " * 12), (7, "same " * 40),
    (8, "filler " * 3000 + LONG), (9, "filler " * 300 + "short item here"), (11, " ".join(reversed(LONG.split()))), (12, "a b c"),
]


@pytest.mark.parametrize("most_words", [50_000, 40])
def test_against_brute_force(spark, most_words):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' as item", "1 as spans")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(docs, bench, most_words=most_words).collect()}
    want = brute(DOCS, BENCH)
    assert got == want
    kept = decontam.keep_clean(docs, bench, most_words=most_words)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[4]}


def test_proximity_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    near = {r.doc_id: r.n_near for r in decontam.report(docs, bench).collect()}
    assert near[11] == 1 and near[12] == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.report(docs, none).collect()} == {0}
    assert decontam.report(docs.limit(0), bench).count() == 0


def test_one_long_item_is_cut_and_no_window_is_lost(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT", 7)
    long = [f"q{i}" for i in range(120)]
    bench = [(1, " ".join(long)), (2, "x y"), (3, " ".join(long[40:60]))]
    docs = [(i, "lead " + " ".join(long[i : i + 13]) + " tail " + "pad " * (i % 5)) for i in range(108)] + [(200, "x y"), (201, None)]
    groups = list(decontam.item_groups(spark.createDataFrame(bench, "item_id long, text string"), most_words=60))
    assert len(groups) > 3 and max(len(w) for g in groups for _, w in g) <= 19
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), most_words=300).collect()}
    assert got == brute(docs, bench)
    sizes = [sum(sum(map(len, w)) for _, w in g) for g in decontam.item_groups(spark.createDataFrame([(i, "word " * 13 + str(i)) for i in range(300)], "item_id long, text string"), most_bytes=4096)]
    assert len(sizes) >= 4 and max(sizes) < 3 * 4096
