"""Resharding by minimum-cost flow: new shards of near equal bytes, moving as little as can be.

Old shards are sources of their bytes, new shards sinks of their capacities; what stays costs
nothing, what moves its bytes. The flow says how many bytes each old shard keeps and how many
it hands to each other one. Rows stand in a line within their old shard, large ones first,
and the line is cut at the flow's amounts, so that the cuts fall between small rows and a
shard misses its capacity by about half a row for each cut.

Places along the lines and in the new shards are prefix sums over hashed cells (a small
table) plus those inside a cell, so that no task sorts a whole shard.

Edge cases: long texts are sizes here and never move but when files are rewritten; equal rows have no
order among each other, so which of them goes is arbitrary; a null text has no bytes (size 1, checksum 0); rows of one id are separate rows;
a null id is a row as any other; an empty table gives an empty result; with less rows than
shards some shards stay empty; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import stored

#: Rows of a cell, about.
CELL_ROWS = 2_000
#: A row of more than this part of a new shard's capacity counts as large.
LARGE = 1 / 512


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> list[list[int]]:
    """Amounts ``f[i][j]`` that take all of ``supply`` to sinks of ``capacity`` at the least cost.

    Successive shortest paths with potentials over the shards' graph. Capacities must hold the supply;
    costs ``cost(i, j)`` are non-negative. Without them staying is free and any move costs one: then
    moves go through one node between old and new shards, and there are only as many edges as shards.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    source, sink, hub, size = n + m, n + m + 1, n + m + 2, n + m + 3
    graph: list[list[list]] = [[] for _ in range(size)]  # [to, room, cost, index of the reverse]

    def edge(a: int, b: int, room: int, price: float) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    if cost is None:
        for i in range(n):
            if i < m:
                edge(i, n + i, supply[i], 0)
            edge(i, hub, supply[i], 1)
        for j in range(m):
            edge(hub, n + j, capacity[j], 0)
    else:
        for i in range(n):
            for j in range(m):
                edge(i, n + j, supply[i], cost(i, j))
    left, height = sum(supply), [0.0] * size
    while left:
        far, via, heap = [float("inf")] * size, [None] * size, [(0.0, source)]
        far[source] = 0.0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (e := d + price + height[a] - height[b]) < far[b]:
                    far[b], via[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far)]
        amount, b = left, sink
        while b != source:
            a, k = via[b]
            amount, b = min(amount, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = via[b]
            graph[a][k][1] -= amount
            graph[b][graph[a][k][3]][1] += amount
            b = a
        left -= amount
    flow = [[0] * m for _ in range(n)]
    out = [0] * n  # through the node between
    for i in range(n):
        for b, room, _, _ in graph[i]:
            if n <= b < n + m:
                flow[i][b - n] += supply[i] - room
            elif b == hub:
                out[i] = supply[i] - room
    into = [[j, capacity[j] - room] for b, room, _, _ in graph[hub] if n <= b < n + m and (j := b - n) >= 0]
    for i, x in enumerate(out):
        while x:
            if not into[-1][1]:
                into.pop()
                continue
            some = min(x, into[-1][1])
            flow[i][into[-1][0]] += some
            into[-1][1] -= some
            x -= some
    return flow


def reshard(docs: DataFrame, old: Column, n_old: int, capacity: list[int] | int) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` for each row of ``docs(doc_id, text)``.

    ``old``: each row's shard now, from 0 to ``n_old - 1``. ``capacity``: bytes each new shard
    may take, or a number of shards of equal capacity. New shard i is old shard i rewritten.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.cast("int").alias("old_shard")), "rows")
    have = {r.old_shard: (r.size, r.n) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    supply = [have.get(i, (0, 0))[0] for i in range(n_old)]
    total, n_rows = sum(supply), sum(n for _, n in have.values())
    if isinstance(capacity, int):
        capacity = [total * (j + 1) // capacity - total * j // capacity for j in range(capacity)]
    flow = min_cost_flow(supply, capacity)
    cuts, targets = [], []
    for i, row in enumerate(flow):
        order = sorted((j for j in range(len(capacity)) if row[j]), key=lambda j: (j != i, j))
        ends = [sum(row[j] for j in order[: k + 1]) for k in range(len(order))]
        cuts.append(ends[:-1])
        targets.append(order or [min(i, len(capacity) - 1)])
    plan = rows.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(zip(cuts, targets))], "old_shard int, cuts array<long>, targets array<int>")
    large = max(1, int(total / len(capacity) * LARGE))
    per_shard = max(1, n_rows // (CELL_ROWS * n_old))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("cell", F.when(F.col("size") > large, -1).otherwise(F.pmod("key", F.lit(per_shard))).cast("int"))
    line = W.partitionBy("old_shard").orderBy("cell")
    cells = rows.groupBy("old_shard", "cell").agg(F.sum("size").alias("bytes")).select("old_shard", "cell", (F.sum("bytes").over(line) - F.col("bytes")).alias("before"))
    inside = W.partitionBy("old_shard", "cell").orderBy(F.when(F.col("cell") < 0, -F.col("size")), "key", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["old_shard", "cell"]).join(F.broadcast(plan), "old_shard")
    middle = 2 * (F.col("before") + F.col("within")) + F.col("size")
    placed = placed.withColumn("shard", F.col("targets")[F.size(F.filter("cuts", lambda c: 2 * c <= middle))])
    placed = stored(placed.select("doc_id", "size", "text_crc32", "old_shard", "cell", "within", "shard"), "placed")
    by_shard = W.partitionBy("shard").orderBy("old_shard", "cell")
    counts = placed.groupBy("shard", "old_shard", "cell").agg(F.count("*").alias("n")).select("shard", "old_shard", "cell", (F.sum("n").over(by_shard) - F.col("n")).alias("first"))
    rank = F.row_number().over(W.partitionBy("shard", "old_shard", "cell").orderBy("within", "doc_id"))
    out = placed.withColumn("rank", rank - 1).join(counts, ["shard", "old_shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("rank")).alias("slot"))


_KEY = ["_shard", "_id", "_size", "_crc"]


def rewrite(plan: DataFrame, path: str) -> list[int]:
    """Rewrite the affected shards of a layout ``path/shard=K`` by what ``reshard`` gave for its rows, and
    return their numbers. A shard that neither gives nor takes a row is left as it is; of one that gives
    all its rows the folder is deleted.

    Rows are found by shard, id, size and checksum; those that are equal in all of these stand for each
    other, and are numbered only where the plan deals them to several shards. All rows are written
    beside the layout and counted before anything in it is replaced; if their number differs, nothing is."""
    spark = plan.sparkSession
    moved = plan.where("shard <> old_shard")
    touched = sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect())
    if not touched:
        return touched
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = spark.read.parquet(path).where(F.col("shard").isin(touched))
    names = [c for c in rows.columns if c != "shard"]
    keyed = rows.select(F.struct(*names).alias("_row"), F.col("shard").alias("_shard"), F.col("doc_id").cast("long").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"))
    want = plan.where(F.col("old_shard").isin(touched)).select(F.col("old_shard").alias("_shard"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    groups = stored(want.groupBy(*_KEY).agg(F.min("shard").alias("low"), F.max("shard").alias("high")), "groups")

    def same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """Joined on equal columns, with nulls equal to nulls, that of ``a`` staying."""
        other = b.select(*[F.col(c).alias(f"{c}_b") if c in on else F.col(c) for c in b.columns])
        cond = F.lit(True)
        for c in on:
            cond &= F.col(c).eqNullSafe(F.col(f"{c}_b"))
        out = a.join(other, cond, how)
        return out if how == "left_semi" else out.drop(*[f"{c}_b" for c in on])

    lone = same(keyed, groups.where("low = high"), _KEY).select("_row", F.col("low").alias("shard"))
    many = groups.where("low < high")
    order = W.partitionBy(*_KEY)
    mine = same(keyed, many, _KEY, "left_semi").withColumn("_n", F.row_number().over(order.orderBy(F.xxhash64("_row"))))
    dealt = same(want, many, _KEY, "left_semi").withColumn("_n", F.row_number().over(order.orderBy(F.col("shard") != F.col("_shard"), "shard", "slot")))
    both = lone.unionByName(same(mine, dealt.select(*_KEY, "_n", "shard"), [*_KEY, "_n"]).select("_row", "shard"))
    fresh = stored(both, "reshard")
    if fresh.count() != rows.count():
        raise ValueError("the plan is not of this layout's rows")
    fresh.select("_row.*", "shard").write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    left = {r[0] for r in fresh.select("shard").distinct().collect()}
    for shard in set(touched) - left:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return touched


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from a layout by source (which is uneven) into eight shards of equal bytes."""
    docs = common.documents(spark, sf_dir)
    old = F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(8))
    out = reshard(docs, old, 8, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
