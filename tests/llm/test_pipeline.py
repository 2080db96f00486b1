"""The corpus pipeline: stages keep the columns of documents, their decisions take effect, and run() is their composition."""

from __future__ import annotations

import corpus_pipeline
import pytest

from tagloom.llm import decontaminate, pipeline, quality, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_columns_and_counts(results):
    for before, after in zip(results[:-2], results[1:-1]):
        assert after.columns == results[0].columns and 0 < after.count() <= before.count()
    assert {"copy", "shuffle_key"} < set(results[-1].columns)


def test_decisions(spark, results):
    docs, good, single, clean, safe, _ = results
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score(docs, model, "s").collect() if r["s"] >= quality.CUT}
    assert {r["doc_id"] for r in good.collect()} == want
    texts = [r["text"] for r in single.collect()]
    assert len(texts) == len(set(texts))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r["doc_id"] for r in decontaminate.matches(single, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - found
    assert {r["doc_id"] for r in safe.collect()} == {r["doc_id"] for r in clean.collect()}
    assert all(not r["secrets"] for r in secrets.scan(safe, ["doc_id"]).collect())


def test_run_equals_stages(spark, results):
    got = sorted((r["doc_id"], r["copy"], r["text"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], r["copy"], r["text"]) for r in results[-1].collect())


def test_stages_do_not_disturb_each_other(spark):
    """A result is still readable after other stages ran; run() leaves nothing but what its result reads."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept: list[str] = []
    single = pipeline.near_duplicate_stage(spark, docs, SF, kept)
    pipeline.secrets_stage(spark, docs, SF).count()
    pipeline.near_duplicate_stage(spark, docs.limit(20), SF).count()
    assert 0 < single.count() < docs.count() and len(kept) == 2


def test_awkward_rows_pass_every_stage(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, secrets string"
    prose = "the river and the stone house with a green window under the garden lamp in the evening"
    rows = [(1, prose, "en", "a", 1, "x"), (1, prose, "en", "a", 1, "x"), (None, prose, None, None, None, None), (2, None, None, None, None, None), (None, None, None, None, None, None), (3, "", "en", "a", 0, None), (4, "word " * 30_000, "en", "a", 1, None), (5, prose + ' token = "abcd1234efgh5678" end', "en", "b", 1, "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            got = after.collect()
            assert set(docs.columns) <= set(after.columns) and (data or not got)
    single = pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r["doc_id"] for r in single), key=str) == [1, 2, 4, 5]
    safe = {r["doc_id"]: r["text"] for r in pipeline.secrets_stage(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert len(safe) == 6 and safe[5] == prose + ' [SECRET]" end' and safe[2] is None
