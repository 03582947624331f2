"""What is done in rounds, against a walk: segments of sessions, acceptance in order, a cursor."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import lock as L, sessions as S
from recollect.streaming import logs


def packed(sizes, budget):
    out, size = [], 0
    for n in sizes:
        if not out or (size > 0 and size + n > budget):
            out.append(0)
            size = 0
        out[-1] += 1
        size += n
    return out


@pytest.mark.parametrize("budget", [1, 7, 50])
def test_segments_of_sessions(spark, budget):
    r = random.Random(budget)
    sessions = {k: [r.choice([0, 0, 1, 3, 8, 60]) for _ in range(r.randrange(1, 40))] for k in range(25)} | {100: [0], 101: [0, 0, 90, 0], 102: [90, 90]}
    rows = [(k, i, None if n == 0 and i % 2 else "x" * n) for k, v in sessions.items() for i, n in enumerate(v)]
    df = spark.createDataFrame(rows, "s int, turn int, body string").repartition(5)
    got = {}
    for x in S.segments(df, "s", "turn", "body", budget).collect():
        got.setdefault(x.s, {})[x.segment] = x.n
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: packed(v, budget) for k, v in sessions.items()}
    assert S.segments(df.limit(0), "s", "turn", "body", budget).count() == 0


def test_a_long_session(spark):
    """A session of 100,000 turns, next to a short one."""
    df = spark.range(100_000).select(F.lit(1).alias("s"), F.col("id").alias("turn"), F.repeat(F.lit("x"), (F.col("id") * 7 % 11).cast("int")).alias("body"))
    both = df.unionByName(spark.createDataFrame([(2, 0, "x")], "s int, turn long, body string"))
    got = {x.segment: x.n for x in S.segments(both, "s", "turn", "body", 400).where("s = 1").collect()}
    assert [got[i] for i in range(len(got))] == packed([i * 7 % 11 for i in range(100_000)], 400)


def test_acceptance_in_order(spark):
    r = random.Random(2)
    aliases = [(f"i{r.randrange(40)}", f"a{r.randrange(40)}") for _ in range(12)]
    ticked = [(f"i{r.randrange(120)}", f"a{r.randrange(120)}", f"p{r.randrange(12)}") for _ in range(400)]
    pages = {f"p{i}" for i in range(9)}
    ids, names, want = {a for a, _ in aliases}, {a for _, a in aliases}, []
    for i, a, p in ticked:
        reason = "no such page" if p not in pages else "id is taken" if i in ids else "alias is taken" if a in names else None
        if reason is None:
            ids.add(i)
            names.add(a)
        want.append((i, a, p, reason))
    assert [tuple(x) for x in L.apply_ticked(spark, aliases, ticked, pages).collect()] == want and sum(x[3] is None for x in want) > 20


AT = lambda minute: datetime.datetime(2024, 1, 1, 12, minute)


def log(spark, rows):
    return spark.createDataFrame([(q, AT(m), c) for q, m, c in rows], "q string, ts timestamp, confidence string")


def ask(prompts):
    return "re: " + prompts


def test_cursor(spark, tmp_path):
    c = logs.Cursor(spark, str(tmp_path / "c"))
    rows = [("b", 1, "none"), ("a", 2, "low"), (" b ", 3, "none"), ("fine", 3, "high"), ("", 3, "none"), ("later", 20, "none")]
    said = lambda: sorted((x.prompt, x["round"]) for x in c.answers().collect())
    assert not c.move(log(spark, rows), None, AT(5)) and c.answers() is None and c.last()[0] == 0
    assert c.move(log(spark, rows), ask, AT(5)) and said() == [("a", 1), ("b", 1)]
    # Late rows are lost, the cursor goes by the clock, and no more than so many are taken.
    rows += [("late", 4, "none"), ("c", 6, "none"), ("d", 7, "none"), ("e", 8, "none")]
    assert c.move(log(spark, rows), ask, AT(10), most=2) and said() == [("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    assert c.move(log(spark, rows), ask, AT(15)) and len(said()) == 4 and c.last()[1] == AT(15)
    # A round that was stopped between its answers and the cursor is done again.
    log(spark, [("half", 16, "none")]).select(F.col("q").alias("prompt"), "ts", F.lit("x").alias("answer")).write.parquet(str(tmp_path / "c" / "answers" / "round=4"))
    assert len(said()) == 4
    assert c.move(log(spark, rows), ask, AT(30)) and said()[-1] == ("later", 4) and len(said()) == 5


def test_cursor_of_a_stream(spark, tmp_path):
    c, clock = logs.Cursor(spark, str(tmp_path / "c")), iter([AT(10), AT(20), AT(30)])
    schema = "q string, ts timestamp, confidence string"
    for some in ([("a", 5, "none")], [("b", 15, "none"), ("early", 7, "none"), ("a", 16, "low")]):
        log(spark, some).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        c.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), ask, lambda: next(clock), str(tmp_path / "p"))
    assert sorted((x.prompt, x["round"]) for x in c.answers().collect()) == [("a", 1), ("a", 2), ("b", 2)]
    assert not c.move(log(spark, [("z", 25, "none")]), ask, AT(40), c.last()[2]) and c.last()[0] == 2
