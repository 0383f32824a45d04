"""Held-out accuracy of the trained models, flat traversal against a plain one, and odd rows."""

import sys

import numpy as np
import pytest

pytest.importorskip("weftmill.llm")
sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
from oracle import connect, same  # noqa: E402

from weftmill.llm import gbdt, quality, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(None, None, 1), (-1, "", 2), (-2, "x " * 50_000, 3), (-3, "same", 4), (-3, "same", 4)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score int")


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    t = gbdt.fit(x[:2000], y[:2000])
    assert gbdt.auc(y[2000:], t.probability(x[2000:])) > 0.97

    def slow(row):
        total = t.base
        for i in t.roots:
            for _ in range(t.depth):
                i = t.left[i] if row[t.feature[i]] <= t.threshold[i] else t.right[i]
            total += t.value[i]
        return total

    assert np.allclose(t.raw(x[:50]), [slow(r) for r in x[:50]])
    assert gbdt.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert gbdt.fit(x, np.ones(3000)).probability(x[:1])[0] > 0.99


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert {r.held_out for r in quality.classify(odd(spark), labels).collect()} <= {True, False}
    assert quality.classify(odd(spark), labels).count() == len(ODD)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert all(r.score == 0.5 for r in quality.classify(odd(spark), labels.limit(0)).collect())
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.FEATURES)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    chain = toxicity.train(docs, seen)
    rows = toxicity.score(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    toxic = [r.rejected for r in rows if r.toxic]
    assert np.mean(toxic) > 0.9 and np.mean([r.rejected for r in rows if not r.toxic]) < 0.01
    assert toxicity.score(odd(spark), chain).count() == len(ODD)
    kept = toxicity.keep_clean(odd(spark), chain)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == len(ODD)
    empty = toxicity.train(docs, labels.limit(0))
    assert not any(r.rejected for r in toxicity.score(odd(spark), empty).collect())


def test_scores_equal_a_plain_version(spark):
    """An independent reading of the model: every word, its prefixes, every link of the chain, one document at a time."""
    import math
    import re

    odd_, full = 0x9E3779B97F4A7C15, 1 << 64

    def mixed(x):
        x %= full
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    assert all(len(m.bucket) for m in chain.models)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    for r in docs.collect():
        hit = set()
        for w in re.split(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", (r.text or "").lower().encode()):
            if w:
                hit.add(mixed(sum(mixed((c + 1) * odd_) * pow(odd_, min(i, 63) + 1, full) for i, c in enumerate(w))) >> 44)
                hit |= {mixed((int.from_bytes(w[:n], "little") + n) * odd_) >> 44 for n in (4, 5, 6) if len(w) >= n}
        logit = []
        for m in chain.models:
            z = m.bias + sum(v for b, v in zip(m.bucket.tolist(), m.weight.tolist(), strict=True) if b in hit) + sum(a * b for a, b in zip(m.chain.tolist(), logit, strict=True))
            p = min(max(1 / (1 + math.exp(-z)), 1e-4), 1 - 1e-4)
            logit.append(math.log(p / (1 - p)))
        assert abs(got[r.doc_id].p_toxic - 1 / (1 + math.exp(-z))) < 1e-6
        assert got[r.doc_id].rejected == (got[r.doc_id].p_toxic >= chain.threshold)


def test_statistics_equal_a_plain_version():
    """The thirty document statistics, one by one, from the words and lines."""
    from collections import Counter
    from math import log1p, log2

    def plain(text):
        raw = text.encode()
        n, ws, lines = len(raw), raw.split(), raw.split(b"\n")
        w = max(1, len(ws))
        count = Counter(raw)
        share = lambda ok: sum(v for c, v in count.items() if ok(c)) / n
        same = [(a, b) for a, b in zip(raw, raw[1:]) if a == b]  # noqa: B905
        sizes = [len(x) for x in ws] or [0]
        is_alpha = lambda c: 65 <= c <= 90 or 97 <= c <= 122
        shouted = sum(any(65 <= c <= 90 for c in x) and not any(97 <= c <= 122 for c in x) for x in ws)
        last = sum(x[-1] < 128 and not chr(x[-1]).isalnum() and chr(x[-1]) not in ".,;:?" for x in ws)
        return [
            log1p(n), log1p(len(ws)), sum(sizes) / len(sizes), share(is_alpha), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c == 32), share(lambda c: c < 32), share(lambda c: c in b"#$%&*+<=>@[]^_{}~\\/"),
            share(lambda c: c >= 128), share(lambda c: c in b".,;:?'\"()-"), share(lambda c: c == 124), sum(a in b"#$%&*+=@^~!" for a, _ in same) / n, share(lambda c: c == 33),
            count[64] / w, shouted / w, last / w, sum(x > 14 for x in sizes) / len(sizes), sum(x < 3 for x in sizes) / len(sizes), sum(48 <= x[0] <= 57 for x in ws) / w,
            len(set(ws)) / w, max(Counter(ws).values(), default=0) / w, log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), max(map(len, lines)) / n,
            (count[46] + count[63] + count[33]) / w, count[44] / w, -sum(v / n * log2(v / n) for v in count.values()), len(same) / n,
        ]

    for text in ("Hello, WORLD! 12ab\n\nHello, WORLD! 12ab\n== ## naïve|café@x.y", "a", "  \t ", "AAAA bbbb!!!! supercalifragilistic it's (so) {odd} \\ / ~~ ok?"):
        assert np.allclose(quality.statistics(text), plain(text)), text


def test_chain_feeds_later_models():
    rng = np.random.default_rng(4)
    n = 900
    y = np.zeros((n, 3))
    y[:, 0] = rng.integers(0, 2, n)
    y[:, 1] = y[:, 0] * rng.integers(0, 2, n)
    y[:, 2] = y[:, 0]
    flat = np.concatenate([[100 + int(a), 200 + int(rng.integers(0, 50))] for a in y[:, 0]])
    chain = toxicity.fit_chain(np.arange(0, 2 * n + 1, 2), flat, y, np.arange(n) % 3)
    assert [len(m.chain) for m in chain.models] == [0, 1, 2] and chain.out_of_fold["toxic"] > 0.99


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, name):
    got, want = same(spark, connect(SF), SF, queries.QUERIES[name], queries.SQL[name])
    assert got == want
