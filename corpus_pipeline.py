"""The corpus pipeline: quality rules, line de-duplication, near-duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before has kept;
its result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents`` (and any others that are there, whatever their names).

Edge cases, in every stage: texts are whole, however long; a null text has no words and goes with
the quality rules, and in the later stages is a document that nothing is found in; null ids are ids
like others; of rows with equal ids each is a document; ties go to the smallest id; a null source counts
as an empty one; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import common, linededup, minhash, packing, quality, templates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null text is rejected."""
    return quality.kept_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring lines that stand in an earlier place go, with ``n_chars`` made anew; so do
    documents of which nothing is left."""
    return linededup.cleaned(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words a shingle, similarity 0.8) one document stays, the one
    with the smallest id; rows are told apart by id and text, so that one id on several texts loses
    none of them to another group. Null ids are the largest."""
    return minhash.one_of_each(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row per piece."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages go by tokenizer, content-defined chunks and templates, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the last one's Parquet."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k}")
    return docs
