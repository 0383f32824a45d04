"""The facade over all sources: order, scope, references, reads, and a source that fails."""

from weftmill.operators import search as Q


def test_sources_answer_together_and_one_may_fail(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", "a/b"), (2, "beta gamma", "a"), (3, "beta delta", "z")], "id long, text string, topic string").withColumnRenamed("topic", "topic").selectExpr("*", "topic AS section")
    pages = spark.createDataFrame([(2, "wiki/two.md", "beta gamma", "a"), (3, "wiki/three.md", "beta beta delta", "z")], "id long, path string, text string, topic string")
    pairs = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "id long, vector array<double>")
    maps = spark.createDataFrame([("bee tah", ["beta"])], "term string, canonicals array<string>")
    q = spark.createDataFrame([(1, "Bee-tah", [0.1, 1.0]), (2, "nothing", [1.0, -1.0])], "qid long, text string, vector array<double>")
    corpus = lambda: Q.Corpus(chunks, mappings=maps)
    got = Q.knowledge_search(q, corpus, lambda: pages, lambda: pairs, scope="a", how="bm25")
    rows = [(r.qid, r.position, r.kind, r.id, r.path) for r in got.results.orderBy("qid", "position").collect()]
    assert rows == [(1, 0, "semantic", 1, None), (1, 1, "semantic", 2, "wiki/two.md"), (1, 2, "keyword", 2, "wiki/two.md")] and got.failed == []
    assert [(r.qid, r.id) for r in got.references.collect()] == [(1, 8)]
    assert [tuple(r) for r in got.reads.collect()] == [(1, "wiki/two.md")] and [tuple(r) for r in Q.read_counts(got.reads).collect()] == [("wiki/two.md", 1)]
    bad = Q.knowledge_search(q, corpus, lambda: spark.read.parquet("file:///nowhere/pages"), None, how="bm25")
    assert bad.failed == ["keyword", "pages"] and {r.kind for r in bad.results.collect()} == {"semantic"} and bad.references.count() == 0


def test_text_search_holds_few_texts_and_pairs_at_once(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from weftmill.operators import retrieval as S

    texts = pa.array([f"{'w%d ' % i}" + "a b c d " * 1000 for i in range(3000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), texts], names=["id", "text"])
    tracemalloc.start()
    got = [(r["id"], r["len"], r["terms"], r["tfs"]) for out in S.counted(iter([batch]), {"a": 0, "w2": 1}) for r in out.to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 8 << 20  # the texts alone are 24 MB
    tracemalloc.stop()
    assert len(got) == 3000 and got[2] == (2, 4001, [1, 0], [1, 1000]) and got[5] == (5, 4001, [0], [1000])
    rng = np.random.default_rng(5)
    ids, scores = rng.permutation(4000), np.round(rng.random((7, 4000)), 2)
    best = S.Best(7, 20)
    for a in range(0, 4000, 300):
        best.add(ids[a : a + 300], scores[:, a : a + 300], 0.5)
    want = [(q, int(ids[i]), s) for q in range(7) for s, i in [(scores[q, i], i) for i in np.lexsort((ids, -scores[q]))[:20]]]
    assert list(zip(best.query.tolist(), best.ids.tolist(), best.scores.tolist(), strict=True)) == want
    assert list(S._runs(np.cumsum([3, 3, 9, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]


def test_text_search_is_the_same_in_small_runs(spark, monkeypatch):
    from weftmill.operators import retrieval as S

    docs = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(1 + i % 7) for _ in range(1 + i % 3))) for i in range(60)], "id long, text string")
    q = spark.createDataFrame([(i, f"t{i} t{i + 1} none") for i in range(6)], "qid long, text string")
    whole = sorted(map(tuple, S.bm25(q, docs, 5).collect()))
    real = S._runs
    monkeypatch.setattr(S, "_runs", lambda done, most: real(done, 2))
    assert whole and sorted(map(tuple, S.bm25(q, docs, 5).collect())) == whole
