"""All queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.plans import answers, locking, memory, retrieval, sources, streams, texts, upkeep  # noqa: F401  they register their queries
from recollect.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all documents for every benchmark text, the first three hits of each."""
    return retrieval.bm25_topk(spark, sf_dir)
