"""A pipeline stage deletes what earlier stages staged, and nothing of results that others still read."""

import os

import corpus_pipeline
from spendloom.llm import tables


def test_scopes(spark, sf_dir, tmp_path):
    rows = spark.range(5)
    mine = tables.stage(rows, "mine")
    with tables.scope("other"):
        theirs = tables.stage(rows, "theirs")
        sorted_ = tables.bucketed(rows, "buckets", "id")
    assert sorted_.count() == 5 and theirs.count() == 5
    tables.release(spark, "other")
    assert mine.count() == 5
    assert not any(os.path.exists(f.removeprefix("file:").rsplit("/", 1)[0]) for f in theirs.inputFiles())


def test_stages_leave_other_results(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    from spendloom.llm import op8_jaccard_join

    lazy = op8_jaccard_join.join(docs)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert corpus_pipeline.pseudonymised(spark, docs, sf_dir).count() == 60
    assert lazy.count() == 60 and kept is not None
