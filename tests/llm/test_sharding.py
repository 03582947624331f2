import random
import zlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import common, sharding

from .conftest import TEXTS


def by_source():
    return F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(8))


def test_flow_moves_the_least():
    r = random.Random(5)
    for _ in range(50):
        n = r.randint(1, 6)
        supply = [r.randint(0, 50) for _ in range(n)]
        total, m = sum(supply), r.randint(1, 6)
        capacity = [total * (j + 1) // m - total * j // m for j in range(m)]
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(x) for x in flow] == supply
        assert [sum(flow[i][j] for i in range(n)) for j in range(m)] == capacity
        moved = sum(flow[i][j] for i in range(n) for j in range(m) if i != j)
        assert moved == sum(max(0, x - (capacity[i] if i < m else 0)) for i, x in enumerate(supply))


def test_flow_takes_the_cheap_way():
    cost = [[0, 5, 1], [1, 0, 9]]
    flow = sharding.min_cost_flow([10, 10], [4, 8, 8], lambda i, j: cost[i][j])
    assert sum(flow[i][j] * cost[i][j] for i in range(2) for j in range(3)) == 10
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4])


def test_odd_rows(odd):
    out = sharding.reshard(odd, by_source(), 8, 8).collect()
    assert len(out) == len(TEXTS)
    want = sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in TEXTS)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == want
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_empty(none):
    assert sharding.reshard(none, by_source(), 8, 8).count() == 0


def test_query_is_even(spark, sf):
    rows = sharding.op1_resharding(spark, sf).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_many_shards():
    r = random.Random(6)
    supply = [r.randint(0, 1000) for _ in range(400)]
    capacity = [sum(supply) * (j + 1) // 300 - sum(supply) * j // 300 for j in range(300)]
    flow = sharding.min_cost_flow(supply, capacity)
    assert [sum(x) for x in flow] == supply and [sum(x) for x in zip(*flow)] == capacity
    assert sum(flow[i][i] for i in range(300)) == sum(map(min, supply, capacity))


def test_no_more_is_moved_than_the_flow_says(spark, sf):
    """But for the rows at the cuts."""
    rows = sharding.op1_resharding(spark, sf).collect()
    supply = [sum(r.size for r in rows if r.old_shard == s) for s in range(8)]
    capacity = [sum(supply) * (j + 1) // 8 - sum(supply) * j // 8 for j in range(8)]
    flow = sharding.min_cost_flow(supply, capacity)
    least = sum(x for i, row in enumerate(flow) for j, x in enumerate(row) if i != j)
    cuts = sum(x > 0 for row in flow for x in row)
    assert abs(sum(r.size for r in rows if r.shard != r.old_shard) - least) <= cuts * max(r.size for r in rows)


LAYOUTS = {
    "plain": ([(i, "x" * (10 + i % 3)) for i in range(60)], None),
    "null ids": ([(None if i % 3 == 0 else i, "x" * (10 + i % 3)) for i in range(60)], None),
    "repeated ids": ([(i // 4, "x" * (10 + i % 3)) for i in range(60)], None),
    "equal rows": ([(7, "same")] * 50 + [(None, None)] * 10, None),
    "a shard becomes empty": ([(i, "x" * (10 + i % 3)) for i in range(60)], (0, 1)),
    "a shard is new": ([(i, "y" * 20) for i in range(60)], (3, 4)),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_rewrite_keeps_every_row(spark, make, tmp_path, name):
    texts, shape = LAYOUTS[name]
    docs = make(texts).drop("shard").withColumn("n_at", F.monotonically_increasing_id())
    old = F.when(F.col("n_at") % 6 < 3, 0).when(F.col("n_at") % 6 == 3, 1).otherwise(2)
    path = str(tmp_path / "layout")
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    have = spark.read.parquet(path)
    size = {r.shard: r.n for r in have.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).collect()}
    total = sum(size.values())
    capacity = [(total - size[2]) // 2, total - size[2] - (total - size[2]) // 2, size[2]]
    if shape == (0, 1):
        capacity = [0, total - size[2], size[2]]
    if shape == (3, 4):
        capacity = [size[0], size[1], size[2] - 200, 200]
    before = {s: {p.name for p in (tmp_path / "layout" / f"shard={s}").glob("part*")} for s in range(3)}
    rows = sorted(map(str, have.drop("shard").collect()))
    plan = common.stored(sharding.reshard(have, F.col("shard"), max(3, len(capacity)), capacity), "plan")
    want = {r.shard: (r.n, r.size) for r in plan.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    touched = sharding.rewrite(plan, path)
    after = spark.read.parquet(path)
    assert sorted(map(str, after.drop("shard").collect())) == rows
    got = after.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")).collect()
    assert {r.shard: (r.n, r.size) for r in got} == want
    for s in set(range(3)) - set(touched):
        assert {p.name for p in (tmp_path / "layout" / f"shard={s}").glob("part*")} == before[s]
    if name == "a shard becomes empty":
        assert 0 not in want and not (tmp_path / "layout" / "shard=0").exists()
    else:
        assert name == "a shard is new" or 2 not in touched


def test_a_plan_of_other_rows_changes_nothing(spark, make, tmp_path):
    path = str(tmp_path / "layout")
    make([(i, "x" * 9) for i in range(20)]).drop("shard").withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(path)
    plan = sharding.reshard(make([(i, "x" * 9) for i in range(19)]), F.lit(0), 2, 2)
    with pytest.raises(ValueError, match="not of this layout"):
        sharding.rewrite(plan, path)
    assert spark.read.parquet(path).count() == 20
