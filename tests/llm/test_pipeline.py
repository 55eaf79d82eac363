"""The corpus pipeline, stage by stage, on documents with planted copies, passages and values."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from spendloom.llm import op3_language, op5_pseudonyms, tables


def test_stages_against_brute_force(spark, sf_dir):
    docs = brute.edge_docs(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"])
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [*stages] == ["language", "near duplicates", "decontamination", "pseudonyms", "packing"]

    def step(name, frame):
        return tables.written(stages[name](spark, frame, sf_dir), "test").persist()

    kept = step("language", docs)
    assert kept.columns == columns
    gone = docs.join(kept, "doc_id", "left_anti").toPandas()
    assert all(t is None or not any(c.isalpha() for c in t) for t in gone["text"][gone["doc_id"] < 10_000])

    single = step("near duplicates", kept)
    components = brute.jaccard([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == {c for _, c in components.values()}

    clean = step("decontamination", single)
    items = [(r["item_id"], r["text"]) for r in tables.read(spark, sf_dir, "benchmark").collect()]
    verdicts = brute.contamination([(r["doc_id"], r["text"]) for r in single.collect()], items)
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {d for d, v in verdicts.items() if not v[-1]}

    private = step("pseudonyms", clean)
    feistel = op5_pseudonyms.Feistel(op5_pseudonyms.session_key(spark))
    assert private.columns == columns
    assert {r["doc_id"]: r["text"] for r in private.collect()} == {r["doc_id"]: op5_pseudonyms.replace(feistel, r["text"])[0] for r in clean.collect()}

    pieces = step("packing", private).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in private.collect()} and pieces.groupby("sequence_id")["length"].sum().max() <= 2048


def test_ids_that_are_null_or_repeat(spark, sf_dir):
    """Each stage judges rows, not ids, and carries columns named like those it makes."""
    stages = dict(corpus_pipeline.STAGES)
    passage = tables.read(spark, sf_dir, "benchmark").where("length(text) > 100").first()["text"]
    prose = [r["text"] for r in tables.read(spark, sf_dir, "documents").where("length(text) > 300").orderBy("doc_id").limit(4).collect()]
    rows = [(None, prose[0]), (None, prose[0]), (None, prose[1]), (3, prose[1]), (4, prose[2]), (4, prose[3]), (4, prose[3]), (None, passage), (5, passage), (6, " "), (6, " "), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, score string, k1 string, node string")
    single = stages["near duplicates"](spark, docs, sf_dir)
    want = [(-1, None), (-1, prose[0]), (3, prose[1]), (4, prose[2]), (4, prose[3]), (5, passage), (6, " "), (6, " ")]
    order = lambda rows: sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert single.columns == docs.columns and order((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in single.collect()) == order(want)
    clean = stages["decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    verdict = brute.contamination([(t, t) for _, t in rows], [(r["item_id"], r["text"]) for r in tables.read(spark, sf_dir, "benchmark").collect()])
    assert verdict[passage][-1] and sorted(str(r["text"]) for r in clean.collect()) == sorted(str(t) for _, t in rows if not verdict[t][-1])
    kept = stages["language"](spark, docs.withColumn("lang", F.lit("en")), sf_dir)
    assert kept.columns == [*docs.columns, "lang"] and sorted(r["text"] for r in kept.collect()) == sorted(t for _, t in rows if (t or "").strip())
    private = stages["pseudonyms"](spark, docs, sf_dir)
    assert private.columns == docs.columns and private.count() == len(rows)
    assert stages["packing"](spark, docs, sf_dir).select("doc_id").where("doc_id is null").count() == 5


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    tables.read(spark, sf_dir, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    tables.read(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert op3_language.UNKNOWN == "und"


def test_nulls_in_every_column(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "some words of a text", None, None, None), (1, None, "en", None, 0)], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()
