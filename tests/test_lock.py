"""Nearest names and the lock against all pairs."""

import random
import re

import pytest

from recollect.operators import lock as L


def form(text):
    """Letters and digits without particles, lower-cased; the texts here have no other signs."""
    return re.sub("[的了着过地得\\s]", "", text).lower()


def near(q, a):
    if not q or not a:
        return 0
    if a == q:
        return 1000 + len(a)
    if a in q:
        return (500 if len(a) >= 4 or 2 * len(a) >= len(q) else 60) + len(a)
    if q in a and (len(q) >= 4 and 2 * len(q) >= len(a) if q.isascii() else len(q) >= 2):
        return 100 + len(q)
    if min(len(q), len(a)) < 2:
        return 0
    n = next((i for i, (x, y) in enumerate(zip(q, a)) if x != y), min(len(q), len(a)))
    shared = len(set(q) & set(a))
    return 40 + n if n >= 2 else 20 + shared if shared >= 2 else 0


@pytest.mark.parametrize("alphabet, size, k", [("abcdefghij", 7, 3), ("abcdefghijklmnopqrstuvwxyz0123456789日本語中文", 30, 5), ("ab的c ", 5, 4)])
def test_suggestions_equal_all_pairs(spark, alphabet, size, k):
    r = random.Random(size)
    text = lambda n: "".join(r.choice(alphabet) for _ in range(r.randrange(1, n)))
    names = [(f"n{i % 60:02}", text(size), f"p{i % 60 % 7}") for i in range(150)]
    names += [("n03", "的", "p3"), ("n04", "", "p4"), names[5], ("z1", names[9][1], "p1")]
    asked = [(i, text(size + 3)) for i in range(60)] + [(100, ""), (101, "的"), (102, names[0][1]), (103, "a"), (104, names[7][1] + names[8][1]), (105, names[1][1])]
    want = {}
    for qid, q in asked:
        best = {}
        for i, a, _ in names:
            if s := near(form(q), form(a)):
                best[i] = max(best.get(i, (0,)), (s, -len(a), a))
        ranked = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:k]
        if ranked:
            want[qid] = [(i, b[0], b[2]) for i, b in ranked]
    got = {}
    rows = L.suggestions(spark.createDataFrame(asked, "qid int, q string"), spark.createDataFrame(names, "id string, alias string, source string"), k)
    for x in sorted(rows.collect(), key=lambda x: (x.qid, x["rank"])):
        got.setdefault(x.qid, []).append((x.id, x.score, x.alias))
    assert got == want


def test_no_key_of_many_names(spark):
    """Names that begin alike are held apart by what is rare in them."""
    names = spark.createDataFrame([(f"n{i}", f"the common name {i:04}x", "p") for i in range(400)], "id string, alias string, source string")
    asked = spark.createDataFrame([(i, f"about the common name {i:04}x today") for i in range(40)], "qid int, q string").selectExpr("replace(q, ' ', '') as _q")
    pairs = L._holding(asked, L._names(names))
    assert 40 <= pairs.count() < 40 * 400 / 10


def sent(df):
    """What the plan sends to every task."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                out.append(x)
    return "\n".join(out)


def test_exploded_questions_are_not_sent_to_every_task(spark, tmp_path, monkeypatch):
    """The questions' file is smaller than what Spark broadcasts; their characters are not."""
    asked = [(i, f"the {'ring' if i % 2 else 'bolt'} {i % 50} of x{i % 7}") for i in range(2000)] + [(3000, "Brand#1"), (3001, "none"), (3002, None)]
    spark.createDataFrame(asked, "qid long, q string").write.parquet(f"{tmp_path}/q")
    words = [("a.md", "ring"), ("b.md", "ring"), ("c.md", "bolt"), ("c.md", "bolt"), ("d.md", "x3"), ("e.md", "bolt 4"), ("f.md", "^Brand#1")]
    q, t = spark.read.parquet(f"{tmp_path}/q"), spark.createDataFrame(words, "rel string, word string")
    want = {}
    for i, x in asked:
        at = [((1000 + len(w) - 1) if w[0] == "^" else len(w), rel) for rel, w in words if x and ((w[0] == "^" and x.lower() == w[1:].lower()) or (w[0] != "^" and w.lower() in x.lower()))]
        if at:
            first = {rel for n, rel in at if n == max(at)[0]}
            want[i] = (min(first), max(at)[0], len(first) > 1)
    for few in (50_000, 2):
        monkeypatch.setattr(L, "FEW_TRIGGERS", few)
        out = L.trigger_match(q, t)
        assert "Generate" not in sent(out)
        assert {r.qid: (r.rel, r.score, r.ambiguous) for r in out.collect()} == want
    names = L._names(spark.createDataFrame([(f"n{i}", f"name {i}", "p") for i in range(50)], "id string, alias string, source string"))
    assert "Generate" not in sent(L._holding(q.select(L.F.col("q").alias("_q")), names))
