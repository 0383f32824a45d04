"""The entity index: folding, field weights, scores, storage."""

import math

from weftmill.operators import entities as E


def _index(spark):
    rows = [("Élan Vital", ["Lebenskraft", "vital force"]), ("Vital", []), ("Müller GmbH", ["Mueller", "MÜLLER"]), ("Tool", None), ("Tool", ["Werkzeug"]), (None, ["nobody"]), ("", ["empty"])]
    return spark.createDataFrame(rows, "entity string, aliases array<string>")


def _match(spark, postings, *texts, k=5):
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    return [(r.qid, r.entity, r["rank"], r.score) for r in E.match(q, postings, k).orderBy("qid", "rank").collect()]


def test_marks_and_case_do_not_matter_and_aliases_find(spark):
    p = E.build(_index(spark))
    assert [x[1] for x in _match(spark, p, "ELAN")] == ["Élan Vital"]
    assert [x[1] for x in _match(spark, p, "muller")] == [x[1] for x in _match(spark, p, "Müller!")] == ["Müller GmbH"]
    assert [x[1] for x in _match(spark, p, "das werkzeug")] == ["Tool"]
    assert _match(spark, p, "", "nothing here") == [] and _match(spark, p, None) == []


def test_scores_are_bm25_by_field_and_decide_the_order(spark):
    p = E.build(_index(spark))
    (_, first, _, a), (_, second, _, b) = _match(spark, p, "vital vital")
    # names with terms: Élan Vital, Vital, Müller GmbH, Tool; aliases with terms: Lebenskraft + vital force, Mueller + MÜLLER, Werkzeug, empty
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    name = lambda n: idf / (1 + 1.2 * (0.25 + 0.75 * n / 1.5))
    alias = math.log(1 + 3.5 / 1.5) / (1 + 1.2 * (0.25 + 0.75 * 3 / 1.75))
    assert (first, second) == ("Élan Vital", "Vital")
    assert math.isclose(a, name(2) + alias, abs_tol=1e-8) and math.isclose(b, name(1), abs_tol=1e-8)
    assert [x[1] for x in _match(spark, E.build(_index(spark), {"alias": 0.0}), "vital")] == ["Vital", "Élan Vital"]
    assert len(_match(spark, p, "vital", k=1)) == 1


def test_stored_index_is_the_same(spark, tmp_path):
    p = E.build(_index(spark))
    E.write(p, f"file://{tmp_path}/index")
    kept = E.load(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, p.collect()))
    assert E.build(_index(spark).limit(0)).count() == 0


def test_chunks_of_the_best_entity_come_first(spark):
    e = _index(spark)
    chunks = spark.createDataFrame([(1, "The elan vital."), (2, "vital signs"), (3, "a tool"), (4, None)], "id long, text string")
    relations = spark.createDataFrame([("Vital", "Tool")], "source string, target string")
    q = spark.createDataFrame([(7, "Elan vital")], "qid long, text string")
    hits = E.search(q, E.build(e), E.mentions(chunks, e), relations, 3).orderBy("rank").collect()
    assert [(h.id, h.entity, h.neighbours) for h in hits] == [(1, "Élan Vital", []), (1, "Vital", ["Tool"]), (2, "Vital", ["Tool"])]


def test_capitals_of_a_question_make_no_other_word(spark, tmp_path):
    from weftmill.plans.registry import QUERIES

    spark.createDataFrame([(0, "ENCHSS oschte"), (1, "Straße Chlich")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "enchß straße")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("ret4_entity_match", "ret4_entity_search"):
        assert {(r.qid, r.entity) for r in QUERIES[name](spark, str(tmp_path)).collect()} == {(7, "Straße")}


def test_the_entities_of_documents_are_read_once_and_only_as_far_as_the_second(spark, tmp_path):
    from pyspark.sql import functions as F

    import weftmill.plans.registry  # noqa: F401  loads the plans in their order
    from weftmill.plans import entity

    texts = ["a Straße Ünïcödé und weiter nichtsda", "abcdefghijklmnop", "onlyone\nsecond two", None, "", "short words", "x1abcdef2ghijkl\n\nmnopqr", "日本語日本語 letters", "a" * 100_000, "\U00010400" * 6 + "-" + "\U00010400" * 7]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entity._entities(spark, str(tmp_path))
    every = F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0))
    want = spark.read.parquet(str(tmp_path / "documents.parquet")).select(every.alias("t")).where(F.size("t") >= 2).select(F.col("t")[0], F.array(F.col("t")[1]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    plan = got._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "regexp" not in plan  # each use of them read and matched all texts again
