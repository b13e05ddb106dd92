"""A corpus pipeline of five stages: language, near copies, repeated passages, test items, packing.

Every stage reads what the one before it wrote. All but the last return the columns of ``documents``. A document that a
filtering stage has no reason to drop stays as it is.

Columns beside those of ``documents`` are left out by every stage. Empty tables give empty results. Texts of any length are
taken whole. Rows that are alike in all columns are near copies of each other: one stays.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecohort.llm import common, decontaminate, langid, minhash, packing, paragraphs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express compression, MinHash or packing; tests check each stage's ids, and most stages' operators against plain versions.
ORACLE_SQL = None


#: Folders of the tables that the stage before worked with.
_used: list[str] = []


def _stage(f):
    """A stage gets its predecessor's rows as they were written, so what the predecessor worked with is deleted first."""

    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete(spark, *_used)
        known = [p for p in common._open if p not in _used]
        common._open[:], _used[:] = known, []
        out = f(spark, docs, sf_dir)
        _used.extend(p for p in common._open if p not in known)
        return out

    return begin


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; lang is what was found. A null text, one without a letter and a narrow margin are rejected."""
    model = langid.fit(common.read(common.tuned(spark), sf_dir, "documents"))
    found = langid.identify(docs, model).filter("not lang_rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id stays. Texts without words have no copies; of rows with one doc_id one stays."""
    common.tuned(spark)
    return minhash.keep_first(docs.select(*COLUMNS))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document holds, whole lines or runs of 50 words; a document with nothing left goes, one that was empty before stays."""
    common.tuned(spark)
    out = paragraphs.remove(docs.select(*COLUMNS), within=False)
    changed = F.col("removed_words") > 0
    return out.filter(~(changed & (F.trim("text") == ""))).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@_stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Null and empty texts are clean; without a benchmark all are."""
    common.tuned(spark)
    return decontaminate.clean(docs.select(*COLUMNS), common.read(spark, sf_dir, "benchmark")).select(*COLUMNS)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it. A null or empty text is its end token alone."""
    common.tuned(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_free),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    work = common.Workspace(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.table(docs)
            common.sweep(spark, work)
    return docs
