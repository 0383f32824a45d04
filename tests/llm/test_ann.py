"""Search results against brute force, recall, and odd rows."""

import numpy as np
import pytest

pytest.importorskip("weftmill.llm")
from weftmill.llm import ann  # noqa: E402


def brute(rows, every=20, k=20, kind=np.float32):
    out = {}
    for i, v in rows:
        if i % every == 0:
            scores = sorted(((-float(ann.in_order(np.asarray([v], dtype=kind).astype(float) * np.asarray([w], dtype=kind).astype(float))[0]), j) for j, w in rows if j != i))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_exact_when_all_cells_are_probed_and_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(200)]
    good += [(1000 + i, good[40][1]) for i in range(60)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [None] + [1.0] * 7), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] + [1.0] * 7), (None, good[0][1]), (2100, [1.0, 2.0]), (2120, []), good[0]]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in good + odd], "vec_id long, embedding array<float>, score double")
    assert collected(ann.search(df, probe=10**6, cell=16, block=16, chunk=4)) == brute(good)


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = collected(ann.search(df))
    hits = []
    for i in ids[ids % 20 == 0]:
        s = x @ x[ids == i][0]
        s[ids == i] = -9
        want = set(ids[np.argsort(-s)[:20]].tolist())
        hits.append(len(want & {j for _, j, _ in got[i]}) / len(want))
    assert np.mean(hits) >= 0.9


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.search(one).count() == 0 and ann.search(one.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(two).collect()] == [(0, 1, 7, 5.0)]


def test_doubles_are_scored_as_doubles(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(500, [1e300] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(ann.search(df, probe=10**6)) == brute(rows, kind=np.float64)


def test_clustered_vectors_are_pruned_and_found(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(300, 16))
    x = (centre[rng.integers(0, 300, 50_000)] + 0.25 * rng.normal(size=(50_000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    schema = "vec_id long, embedding array<float>"
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 16).cast(pa.list_(pa.float32()))}), schema)
    index = ann.materialize(ann.entries(ann.usable(df), 20), "entries")
    made = ann.Index(index, 256, None, 20_000, 1024)
    queries = index.where("cid % 100 = 50").select("cid", "v")
    probe = ann.measured_probe(queries, made.placed, made, 20, 0.97, 256)
    assert probe < len(x) / 2
    got = collected(ann.search(df, every=500, probe=probe))
    hits, held = [], np.arange(500, len(x), 1000)  # none of these has set probe
    for i in held.tolist():
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -9
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & {j for _, j, _ in got[i]}) / 20)
    assert np.mean(hits) >= 0.95


@pytest.mark.parametrize("huge", [1e8, 1e12])
def test_long_vectors_that_cancel_lose_no_neighbour(spark, huge):
    rng = np.random.default_rng(11)
    rows = [(i, [huge if i % 2 else -huge, huge, *rng.normal(size=6).tolist()]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(ann.search(df, probe=10**6)) == brute(rows, kind=np.float64)


def test_scores_that_overflow_are_ordered(spark):
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=4) * (1e200 if i % 3 == 0 else 1.0)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for probe in (10**6, None):
        got = collected(ann.search(df, probe=probe))
        assert len(got) == 12 and all(len(v) == 20 for v in got.values())
        if probe:
            for i, hits in got.items():
                with np.errstate(all="ignore"):
                    scores = [(float(ann.in_order(np.array([rows[i][1]]) * np.array([w]))[0]), j) for j, w in rows if j != i]
                want = sorted(scores, key=lambda x: (-x[0] if x[0] == x[0] else np.inf, x[1]))[:20]
                assert [j for _, j, _ in hits] == [j for _, j in want]


def test_held_out_recall_is_measured(spark, caplog):
    import logging

    rng = np.random.default_rng(13)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(4000)]
    with caplog.at_level(logging.INFO, logger="weftmill.llm.ann"):
        ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count()
    line = next(r.getMessage() for r in caplog.records if "held-out recall" in r.getMessage())
    assert float(line.rsplit(" ", 1)[1]) >= 0.9
