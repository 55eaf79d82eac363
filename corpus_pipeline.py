"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Every stage takes all documents its predecessor kept. All but the last return the columns
of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import (
    op1_decontamination,
    op3_language,
    op5_pseudonyms,
    op8_jaccard_join,
    op10_packing,
    tables,
)

#: A text whose likeliest language holds less than this share of it is rejected.
LEAST_SCORE = 0.5

SCOPE = "pipeline"

#: Learned labels, sketches and keyed pseudonyms are not for SQL; tests compare with brute force.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _scoped(stage: Stage) -> Stage:
    """The stage in the pipeline's scope: what earlier stages left there goes, their results being written."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables.release(spark, SCOPE)
        with tables.scope(SCOPE):
            return stage(spark, docs, sf_dir)

    return run


def _having(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs with or without (left_semi, left_anti) their k1 and k2 among keys."""
    keyed = docs.withColumns({f"_row_{k}": v for k, v in tables.row_keys("doc_id", "text").items()})
    keys = keys.select(F.col("k1").alias("_row_k1"), F.col("k2").alias("_row_k2"))
    return keyed.join(keys, ["_row_k1", "_row_k2"], how)


@_scoped
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with one main language; null texts and texts without letters go.

    Every row is judged by its own text, also those without an id and repeated ones; texts of
    any length are read whole, other columns are carried, and of equal scores the first
    language by name counts. An empty table stays empty.
    """
    model = op3_language.fit_on_kept(docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # The columns travel as one struct, so that none clashes with a predicted one.
    asked = docs.select("doc_id", "text", F.struct(*rest).alias("_rest")) if rest else docs
    found = op3_language.predict(asked, model, keep=["text", *(["_rest"] if rest else [])])
    found = found.where((F.col("lang_pred") != op3_language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns))


@_scoped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of similar texts: that of the smallest id.

    Ids may be null (such a row is kept only if none of its component has an id) or repeat (of
    two texts with one id one is kept); of rows that repeat id and text one stays. Texts
    without words are similar to nothing and all stay. Other columns are carried; an empty
    table stays empty.
    """
    found = op8_jaccard_join.groups(docs)
    first = found.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")).alias("row"))
    keep = _having(docs, first.select("row.*"), "left_semi").dropDuplicates(["_row_k1", "_row_k2"])
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return keep.select(docs.columns).union(wordless)


@_scoped
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are contaminated by the benchmark.

    Every row is judged by its own text, also those without an id and repeated ones; null texts
    are clean. Other columns are carried; an empty table stays empty.
    """
    found = op1_decontamination.contamination(docs, tables.read(spark, sf_dir, "benchmark"), keys=True)
    return _having(docs, found.where("contaminated").select("k1", "k2").distinct(), "left_anti").select(docs.columns)


@_scoped
def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by keyed pseudonyms of the same format.

    All rows stay, with all columns; null and empty texts stay as they are, and repeated rows
    are changed alike.
    """
    return op5_pseudonyms.pseudonymise(docs, op5_pseudonyms.session_key(spark))


@_scoped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences.

    A null text packs as its end token; repeated rows are packed each; ids may be null; other
    columns are not read. An empty table gives no pieces.
    """
    return op10_packing.pack(docs, public_tokenizers.path(op10_packing.VOCABULARY))


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pseudonyms", pseudonymised),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read back before the next."""
    docs = tables.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
