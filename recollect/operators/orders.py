"""Order over a whole table in parallel: places and running sums without a task that sees all rows.

Rows are parted by ranges of the order and written; the totals of the parts, one row each, are
summed up in the order of the parts; within a part a window does the rest, from the sums before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.plans.place import place


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``at``, the place of each row in ``order`` from 1 on, and for every one of ``sums`` (name to
    integer column) its sum over the rows up to this one. The order must tell rows apart."""
    spark, sums = df.sparkSession, sums or {}
    held = place(spark, "ordered")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = df.select("*", *[c.alias(f"_{k}") for k, c in sums.items()])
    named.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.parquet(held)
    rows = spark.read.parquet(held)
    totals = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(f"_{k}") for k in sums])
    before, so_far = [], [0] * (1 + len(sums))
    for r in sorted(totals.collect()):  # one row a part
        before.append((r[0], *so_far))
        so_far = [a + b for a, b in zip(so_far, r[1:])]
    starts = spark.createDataFrame(before, ", ".join(["_part int", "_before long", *(f"_before_{k} long" for k in sums)]))
    w = W.partitionBy("_part").orderBy(*order)
    out = rows.join(F.broadcast(starts), "_part").withColumn("at", F.row_number().over(w) + F.col("_before"))
    for k in sums:
        out = out.withColumn(k, F.coalesce(F.sum(f"_{k}").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) + F.col(f"_before_{k}"))
    return out.select(*df.columns, "at", *sums)
