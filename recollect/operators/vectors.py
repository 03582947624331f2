"""Dense retrieval: a stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors in one block.
BLOCK = 2048


def dense_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, floor: float | None = None, digits: int = 4) -> DataFrame:
    """``qid, key, score, rank``: the ``k`` nearest rows by cosine to each of
    ``queries(qid, vector)``, itself left out if ``qid`` is the key; ties by key.

    Queries are sent to the rows in blocks of about ``BLOCK``; each batch of rows meets a block in one
    matrix product and hands on its best ``k``, so a row's vector is never shuffled, whatever the
    number of queries."""
    sc = vectors.sparkSession.sparkContext
    asked = queries.select("qid", F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n = max(1, -(-asked.count() // BLOCK))
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")

    def unit(x):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size == 0, 1, size)

    def near(known):
        def run(batches):
            for batch in batches:
                qids, q = known.value
                found = [(np.empty(0, np.int64),) * 2 + (np.empty(0),)]
                if batch.num_rows and len(qids):
                    ids = batch.column("_key").to_numpy()
                    s = np.round(q @ unit(batch.column("_v").flatten().to_numpy().reshape(batch.num_rows, -1)).T, digits)
                    s[qids[:, None] == ids[None, :]] = -np.inf
                    for i, qid in enumerate(qids):
                        order = np.lexsort((ids, -s[i]))[:k]
                        order = order[np.isfinite(s[i, order]) & (s[i, order] >= (-np.inf if floor is None else floor))]
                        found.append((np.full(len(order), qid), ids[order], s[i, order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["qid", key, "score"])

        return rows.mapInArrow(run, f"qid long, {key} long, score double")

    pairs = None
    for b in range(n):
        got = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b).toArrow()
        ids = got["qid"].to_numpy().astype(np.int64)
        block = unit(got["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)) if len(ids) else np.empty((0, 0))
        some = near(sc.broadcast((ids, block)))
        pairs = some if pairs is None else pairs.unionByName(some)
    w = W.partitionBy("qid").orderBy(F.desc("score"), key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def decide(lexical: DataFrame, dense: DataFrame, rule: str) -> DataFrame:
    """``qid, cited`` (null: refused) from the first hits ``qid, cited`` of two systems.

    ``rescue``: the second answers where the first refuses; ``gate``: the first answers only
    where the second does too; ``agree``: only where both cite the same."""
    both = lexical.select("qid", F.col("cited").alias("a")).join(dense.select("qid", F.col("cited").alias("b")), "qid", "full_outer")
    pick = {"rescue": F.coalesce("a", "b"), "gate": F.when(F.col("b").isNotNull(), F.col("a")), "agree": F.when(F.col("a") == F.col("b"), F.col("a"))}[rule]
    return both.select("qid", pick.alias("cited"))


def vote(hits: DataFrame, label: str, least: int = 2) -> DataFrame:
    """``qid, label, votes``: the label that most of a question's hits bear, the smallest
    among equals; none under ``least`` votes."""
    n = hits.groupBy("qid", label).agg(F.count("*").alias("votes"))
    w = W.partitionBy("qid").orderBy(F.desc("votes"), label)
    return n.withColumn("r", F.row_number().over(w)).where((F.col("r") == 1) & (F.col("votes") >= least)).drop("r")
