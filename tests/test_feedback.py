"""Feedback and manual additions against a plain loop."""

import math
import random

from weftmill.operators import feedback as B
from weftmill.operators import retrieval as S

IN = "n long, question string, vector array<double>, answer string, sources array<string>, feedback string"


def near(vectors, v, t):
    best = None
    for i, w in vectors.items():
        if v and w and any(v) and any(w):
            s = round(sum(a * b for a, b in zip(v, w, strict=True)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w)), 6)
            if s >= t and (best is None or (-s, i) < best):
                best = (-s, i)
    return best


def test_feedback_lands_as_in_a_loop(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]
    pairs = [(i, f"q{i}", vec(), f"a{i}", ["wiki/x.md"] if i % 2 else None, rng.choice(["up", "down", None])) for i in range(4)]
    inputs = [(n, f"in{n}", rng.choice([vec(), vec(), None]) if n % 9 == 0 else vec(), rng.choice(["a1", "new", "b"]), rng.choice([None, ["wiki/x.md", "wiki/y.md"], ["other", "", "wiki/y.md"]]), rng.choice(["up", "down"])) for n in range(40)]
    vectors = {p[0]: p[2] for p in pairs}
    state = {p[0]: (p[1], p[3], p[4] or [], p[5]) for p in pairs}
    moves, ids = {}, {}
    for n, q, v, a, s, f in inputs:
        best = near(vectors, v, 0.9)
        i = best[1] if best else -n - 1
        ids[n] = (i, -best[0] if best else None)
        own = [x for x in dict.fromkeys(s or []) if x.strip()]
        if best is None:
            vectors[i] = v
            before, state[i] = None, (q, a, own, f)
        else:
            oq, oa, os_, before = state[i]
            state[i] = (oq, oa if oa == a else f"{oa}\n\n{a}", list(dict.fromkeys(os_ + own)), f)
        if before != f:
            for p in own:
                if p.startswith("wiki/"):
                    moves[p, f] = moves.get((p, f), 0) + 1
    after, matches, moved = B.record(spark.createDataFrame(pairs, B.PAIRS), spark.createDataFrame(inputs, IN))
    assert {r.n: (r.id, r.score) for r in matches.collect()} == ids
    assert {r.id: (r.question, r.answer, r.sources, r.feedback) for r in after.collect()} == state
    assert {(r.path, r.feedback): r.moves for r in moved.collect()} == moves
    assert len({i for i, _ in ids.values()}) < 40 > sum(i < 0 for i, _ in ids.values()) > 3


def test_manual_additions(spark):
    pairs = spark.createDataFrame([(1, "What is X-Day?", [1.0, 0.0], "the day", ["wiki/a.md"], "up")], B.PAIRS)
    rows = [(0, "what is x-day", [1.0, 0.1], "x", None, None), (1, "x-day", [1.0, 0.1], "also", ["wiki/b.md"], "merge"), (2, "invoice", [0.0, 1.0], "file it", None, "merge"), (3, "invoices", [0.1, 1.0], "again", None, "add-anyway"), (4, "x day", [1.0, 0.0], "only this", [], "overwrite"), (5, "none", None, "n", None, None)]
    after, out = B.manual_add(pairs, spark.createDataFrame(rows, "n long, question string, vector array<double>, answer string, sources array<string>, mode string"))
    assert [(r.n, r.id, r.action) for r in out.orderBy("n").collect()] == [(0, 1, "needs_decision"), (1, 1, "merged"), (2, None, "inserted"), (3, -3, "added_anyway"), (4, 1, "overwritten"), (5, None, "inserted")]
    assert {r.id: (r.question, r.answer, r.sources, r.feedback) for r in after.collect()} == {1: ("What is X-Day?", "only this", [], None), -3: ("invoice", "file it", [], None), -4: ("invoices", "again", [], None), -6: ("none", "n", [], None)}


def test_nothing_comes(spark):
    pairs = spark.createDataFrame([(1, "q", [1.0], "a", None, None)], B.PAIRS)
    after, matches, moves = B.record(pairs, spark.createDataFrame([], IN))
    assert [(r.id, r.answer, r.sources) for r in after.collect()] == [(1, "a", [])] and matches.count() == moves.count() == 0


def test_no_vector_reaches_the_driver(spark, monkeypatch):
    for name, size in {"SIDE": 6, "SETTLED": 5, "STEP": 3}.items():
        monkeypatch.setattr(B, name, size, raising=False)
    rng = random.Random(5)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]
    pairs = [(i, vec()) for i in range(3)]
    inputs = [(n, [None, 1.0, 0.0, 0.0] if n == 8 else vec(), n % 6 == 2) for n in range(60)]
    vectors, want = dict(pairs), {}
    for n, v, always in inputs:
        best = None if None in v else near(vectors, v, 0.8)
        want[n] = (best[1] if best else -n - 1, -best[0] if best else None, always or best is None)
        if want[n][2] and None not in v:
            vectors[-n - 1] = v
    a, b = spark.createDataFrame(pairs, "id long, vector array<double>"), spark.createDataFrame(inputs, "n long, vector array<double>, always boolean")

    def guarded(call):
        def run(self, *args, **kwargs):
            assert "vector" not in self.columns, "vectors come to the driver"
            return call(self, *args, **kwargs)

        return run

    with monkeypatch.context() as m:
        for name in ("collect", "toLocalIterator"):
            m.setattr(type(a), name, guarded(getattr(type(a), name)))
        out = B.assign(a, b, 0.8, b["always"])
    assert {r.n: (r.id, r.score, r.made) for r in out.collect()} == want
    assert sum(made for _, _, made in want.values()) > 12
