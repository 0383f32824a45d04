"""Each stage of the pipeline against a plain version on its own input, and the whole run."""

import sys

import pytest

pytest.importorskip("weftmill.llm")
sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_decontam import brute as windows  # noqa: E402
from test_simhash import slow_components, slow_fingerprint  # noqa: E402

from weftmill.llm import pii, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema

    def again(df):
        assert df.columns == schema.names
        rows = [tuple(r) for r in df.collect()]
        return rows, spark.createDataFrame(rows, schema)

    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity._Scorer(chain)
    rows, kept = again(stages["toxicity"](spark, docs, SF))
    assert {r[0] for r in rows} == {r.doc_id for r in docs.collect() if scorer.score(r.text)[-1] < chain.threshold}
    fps = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_components([r[0] for r in rows], fps)
    rows, kept = again(stages["near_duplicates"](spark, kept, SF))
    assert {r[0] for r in rows} == {d for d, c in roots.items() if d == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = windows([(r[0], r[1]) for r in rows], bench)
    rows, kept = again(stages["decontamination"](spark, kept, SF))
    assert {r[0] for r in rows} == {d for d, v in hit.items() if not v[4]}
    judge = pii.train(kept)
    want = {r[0]: pii.redacted(r[1], judge) for r in rows}
    rows, kept = again(stages["personal_data"](spark, kept, SF))
    assert {r[0]: r[1] for r in rows} == want and all(not pii.scan(r[1]) for r in rows)
    pieces = stages["packing"](spark, kept, SF).collect()
    assert {p.doc_id for p in pieces} == {r[0] for r in rows}
    whole = corpus_pipeline.run(spark, SF)
    assert sum(p.length for p in whole.collect()) == sum(p.length for p in pieces)


def odd_documents(spark):
    long = "plain words of a very long text, one after another. " * 4000
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, long, "de", "s", len(long)), (3, long, "de", "s", len(long)), (3, "another text with the same id", "en", "t", 1), (None, "no id at all here", "en", "t", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "'x' as key", "1 as fp", "2 as component_id", "3 as item", "4 as row_id", "5 as sequence_id")


def test_odd_rows_and_empty_tables_at_every_stage(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0 and nothing.columns == got.columns
        rows = got.collect()
        if name == "packing":
            assert sum(r.start == 0 for r in rows) == docs.count()
            continue
        assert got.columns == docs.columns
        ids = sorted(str(r.doc_id) for r in rows)
        if name == "near_duplicates":  # null and empty texts are one component; of the three rows with id 3 one stays
            assert ids == ["1", "3", "None", "None"]
        else:
            assert ids == sorted(str(r.doc_id) for r in docs.collect()), name


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    import os

    from weftmill.llm import common

    monkeypatch.setattr(common, "scratch_root", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and [n.split("-")[-1] for n in os.listdir(tmp_path / "weftmill")] == ["packing"]


def test_a_failed_stage_leaves_no_tables(spark, tmp_path, monkeypatch):
    import os

    from weftmill.llm import common

    monkeypatch.setattr(common, "scratch_root", lambda _: f"file://{tmp_path}")
    with pytest.raises(ZeroDivisionError), common.scratch_tables(spark):
        common.materialize(spark.range(5).toDF("id"), "first")
        assert len(os.listdir(tmp_path / "weftmill")) == 1
        raise ZeroDivisionError
    assert os.listdir(tmp_path / "weftmill") == []
