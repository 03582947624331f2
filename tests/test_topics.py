"""Evidence of topics against a walk over the pages; the report on an alias table."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.operators import literal, lock, topics


def walk(pages, terms, own, budget):
    """Page after page, as a reader would gather it."""
    out = {}
    for topic in {t for t, _ in terms} | {t for t, _ in own}:
        words = [w.lower() for t, w in terms if t == topic and w]
        first, second, third = [], [], []
        for rel, day, text in pages:
            text = text or ""
            if (topic, rel) in own:
                first.append((rel, f"### [{topics.KINDS[0]}] {rel}\n{text[: topics.WHOLE]}"))
                continue
            lines = text.split("\n")
            hits = [i for i, x in enumerate(lines) if any(w in x.lower() for w in words)]
            if not hits:
                continue
            near = sorted({j for i in hits[: topics.HITS] for j in (i - 1, i, i + 1) if 0 <= j < len(lines)})
            body = "\n".join(lines[j] for j in near if lines[j].strip())[: topics.EXCERPT]
            if day is None:
                second.append((len(hits), rel, f"### [{topics.KINDS[1]}] {rel}\n{body}"))
            else:
                third.append((day, rel, f"### [{topics.KINDS[2]} {day}] {rel}\n{body}"))
        line = [b for _, b in sorted(first)] + [x[2] for x in sorted(second, reverse=True)] + [x[2] for x in sorted(third, reverse=True)]
        size, kept = 0, []
        for block in line:
            size += len(block)
            if size > budget:
                break
            kept.append((len(kept) + 1, block, size))
        if kept:
            out[topic] = kept
    return out


@pytest.mark.parametrize("seed,budget", [(1, 30_000), (2, 900), (3, 40)])
def test_evidence_equals_a_walk(spark, tmp_path, seed, budget):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "gam ma", "", " ", "ÄRGER", "x"])
    pages = [(f"p{i:03}.md", None if r.random() < 0.6 else f"2025-{r.randrange(1, 13):02}", "\n".join(" ".join(word() for _ in range(r.randrange(4))) for _ in range(r.randrange(0, 40)))) for i in range(80)]
    pages += [("long.md", None, "alpha line\n" * 900), ("null.md", None, None), ("empty.md", "2025-01", "")]
    terms = [("a", "alpha"), ("a", "ALPHA"), ("a", "a b"), ("b", "BETA"), ("b", "x"), ("c", "ärger"), ("d", "nowhere at all"), ("e", ""), ("e", "x\ny")]
    own = {("a", "p001.md"), ("a", "null.md"), ("f", "p002.md"), ("b", "not there.md")}
    df = spark.createDataFrame(pages, "rel string, day string, text string")
    grams = literal.Grams.build(df, "rel", F.col("text"), str(tmp_path / "grams"))
    got = {}
    out = topics.evidence(grams, df, F.col("text"), spark.createDataFrame(terms, "topic string, term string"), spark.createDataFrame(list(own), "topic string, rel string"), budget)
    for x in out.orderBy("topic", "place").collect():
        got.setdefault(x.topic, []).append((x.place, x.block, x.upto))
    assert got == walk(pages, terms, own, budget)


def test_a_topic_of_many_pages_is_ranked_in_parts(spark):
    """No task reads all pages of a topic; what it gets from a part fits into the budget."""
    r = random.Random(4)
    pages = [(i, None if i % 3 else f"2025-{1 + i % 12:02}", "\n".join(r.choice(["alpha", "beta", "none of it"]) for _ in range(r.randrange(1, 30)))) for i in range(3000)]
    terms, own = [("a", "alpha"), ("b", "beta")], {("a", 17), ("b", 2999)}
    df = spark.createDataFrame(pages, "rel int, day string, text string")
    out = topics.evidence(literal.Scan(df, "rel", F.col("text")), df, F.col("text"), spark.createDataFrame(terms, "topic string, term string"), spark.createDataFrame(list(own), "topic string, rel int"), 1500)
    got = {}
    for x in out.orderBy("topic", "place").collect():
        got.setdefault(x.topic, []).append((x.place, x.block, x.upto))
    assert got == walk(pages, terms, own, 1500)
    # Of what is ranked as a whole topic, each part was ranked by itself before.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    by = [bool(x) for x in re.findall(r"windowspecdefinition\(topic#\d+(, _part#\d+)?", plan)]
    assert not by[0] and by[-1]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "rel string, day string, text string")
    grams = literal.Grams.build(none, "rel", F.col("text"), str(tmp_path / "grams"))
    assert topics.evidence(grams, none, F.col("text"), spark.createDataFrame([("a", "b")], "topic string, term string"), spark.createDataFrame([], "topic string, rel string")).count() == 0


def test_alias_table_report(spark):
    aliases = [("1", "alpha", "a.md"), ("1", "first", "a.md"), ("2", "beta", "gone.md"), ("3", "gamma", "old.md"), ("4", "delta", "d.md"), ("4", "other", "e.md"), ("5", "alpha", "a.md"), ("6", "twin", "d.md"), ("7", "twin", "e.md"), ("8", "zeta", "dead.md"), ("9", "!!", "a.md")]
    day = dt.date(2025, 1, 1)
    pages = [("a.md", None, None, None), ("d.md", day, None, "active"), ("e.md", None, dt.date(2026, 1, 1), ""), ("old.md", None, day, "active"), ("dead.md", None, None, "superseded")]
    out = lock.proven(spark.createDataFrame(aliases, "id string, alias string, source string"), spark.createDataFrame(pages, "rel string, valid_from date, invalid_at date, status string"), F.lit("2025-06-01").cast("date"))
    assert {tuple(r) for r in out.collect()} == {
        ("2", "missing", None, "gone.md"), ("3", "not in force", None, "old.md"), ("8", "not in force", None, "dead.md"), ("4", "several sources", None, None),
        ("5", "locks another row", "alpha", "1"), ("6", "locks nothing", "twin", None), ("7", "locks nothing", "twin", None), ("9", "locks nothing", "!!", None),
    }
