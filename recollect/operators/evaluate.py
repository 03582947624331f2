"""Grading retrievers: wrong citations, refusals, floors, coverage curves, paired bootstrap."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.operators.orders import running
from recollect.plans.place import place


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def graded(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question with what was cited: ``answered, wrong, right, refused``.

    ``questions(qid, kind, gold)``, ``answers(qid, cited, score)``; a question without an
    answer row or citation counts as refused, an answered one without gold is wrong."""
    g = questions.join(answers, "qid", "left")
    answered = F.col("cited").isNotNull()
    right = answered & F.col("cited").eqNullSafe(F.col("gold"))
    return g.select(*questions.columns, "cited", "score", answered.alias("answered"), (answered & ~right).alias("wrong"), right.alias("right"), (~answered).alias("refused"))


def summary(grades: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and the wrong rate, overall and, with ``by``, for each slice."""
    n = lambda c: F.sum(F.col(c).cast("int")).cast("long").alias(f"n_{c}")
    agg = [F.count("*").alias("n"), n("answered"), n("wrong"), n("right"), n("refused"), rate(F.sum(F.col("wrong").cast("int")), F.sum(F.col("answered").cast("int"))).alias("wrong_rate")]
    if by is None:
        return grades.agg(*agg)
    return grades.rollup(by).agg(*agg).withColumn(by, F.coalesce(F.col(by), F.lit("all")))


def _by_score(grades: DataFrame) -> DataFrame:
    """``score, n, r``: answers and right ones of each score that occurs."""
    return grades.where("answered").groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("right").cast("long")).alias("r"))


def _floor_row(floor: Column) -> list[Column]:
    a, r = F.col("n_answered"), F.col("n_right")
    return [floor.alias("floor"), a, r, (a - r).alias("n_wrong"), (2 * r - a).alias("points")]


def floors(grades: DataFrame, cuts: DataFrame) -> DataFrame:
    """``floor, n_answered, n_right, n_wrong, points``: what stays answered at each floor of
    ``cuts(floor)``. Cuts stand in one order with the scores, behind those they let pass, and take
    the running sums that are there."""
    marks = cuts.select(F.col("floor").cast("double").alias("score")).distinct().select("score", F.lit(True).alias("cut"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("r"))
    both = _by_score(grades).select(F.col("score").cast("double").alias("score"), F.lit(False).alias("cut"), "n", "r").unionByName(marks)
    run = running(both, [F.desc("score"), F.asc("cut")], {"n_answered": F.col("n"), "n_right": F.col("r")})
    return run.where("cut").select(*_floor_row(F.col("score")))


def floor_table(grades: DataFrame) -> DataFrame:
    """The same at every score that occurs."""
    run = running(_by_score(grades), [F.desc("score")], {"n_answered": F.col("n"), "n_right": F.col("r")})
    return run.select(*_floor_row(F.col("score")))


def pick_floor(grades: DataFrame) -> DataFrame:
    """The floor with the most right less wrong answers, the lowest among equals."""
    return floor_table(grades).orderBy(F.desc("points"), "floor").limit(1)


def with_floor(answers: DataFrame, floor: float) -> DataFrame:
    """Answers below the floor become refusals."""
    return answers.withColumn("cited", F.when(F.col("score") >= floor, F.col("cited")))


def without_dead(ranked: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """Ranked hits without dead pages, ranks made anew."""
    keep = ranked.join(dead.select(key), key, "left_anti")
    return keep.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")))


def coverage_curve(grades: DataFrame, points: int = 12) -> DataFrame:
    """``n_answered, n_wrong, wrong_rate`` at ``points`` cuts, strict to loose, over answers
    in order of score (ties by question)."""
    some = grades.where("answered")
    total = some.agg(F.count("*").alias("total"))
    run = running(some, [F.desc("score"), F.asc("qid")], {"_wrong": F.col("wrong").cast("long")})
    cuts = total.select(F.explode(F.sequence(F.lit(1), F.lit(points))).alias("cut"), "total").select("cut", F.greatest(F.lit(1), F.floor(F.col("cut") * F.col("total") / points)).alias("at"))
    met = run.join(F.broadcast(cuts), "at")  # as many rows as points
    return met.select("cut", F.col("at").alias("n_answered"), F.col("_wrong").alias("n_wrong"), rate(F.col("_wrong"), F.col("at")).alias("wrong_rate"))


def at_coverage(answers: DataFrame, n: int) -> DataFrame:
    """Only the ``n`` answers with the highest scores stay."""
    run = running(answers, [F.col("cited").isNull().asc(), F.desc("score"), F.asc("qid")])
    return run.withColumn("cited", F.when(F.col("at") <= n, F.col("cited"))).drop("at")


#: Questions of which resamples are drawn on the driver, one after another, at most.
QUESTIONS = 20_000


def draws(spark, n: int, reps: int = 2000, seed: int = 20261013) -> DataFrame:
    """``rep, pos``: resamples of 0..n-1 from one stream of the standard generator, so that equal seeds
    give the published intervals."""
    if n > QUESTIONS:
        raise ValueError(f"a question set holds up to {QUESTIONS} questions")
    import numpy as np
    import pyarrow as pa

    r = random.Random(seed)
    pos = np.fromiter((r.randrange(n) for _ in range(reps * n)), np.int32, reps * n)
    return spark.createDataFrame(pa.table({"rep": np.repeat(np.arange(reps, dtype=np.int32), n), "pos": pos}))


def bootstrap(grades: DataFrame, other: DataFrame | None = None, reps: int = 2000, seed: int = 20261013, order: str = "qid") -> DataFrame:
    """``metric, low, high`` (95 %) of the wrong rate, the right and the refused answers over resamples of the
    questions, and with ``other`` (another system's grades of the same questions) of the differences, on
    the same resamples. Bounds are the order statistics at int(0.025 (reps - 1)) and int(0.975 (reps - 1))."""
    spark, n = grades.sparkSession, grades.count()
    if not n:
        return spark.createDataFrame([], "metric string, low double, high double")
    place = (F.row_number().over(W.orderBy(order)) - 1).alias("pos")  # a question set, of bounded size
    flags = lambda df, s: df.select("qid", *[F.col(c).cast("int").alias(f"{c}{s}") for c in ("answered", "wrong", "right", "refused")])
    rows = grades.select("qid", place).join(flags(grades, ""), "qid")
    sides = [""]
    if other is not None:
        rows = rows.join(flags(other, "_b"), "qid", "left").fillna(0).withColumn("refused_b", 1 - F.col("answered_b"))
        sides.append("_b")
    times = draws(spark, n, reps, seed).groupBy("rep", "pos").agg(F.count("*").alias("m"))
    sums = times.join(rows, "pos").groupBy("rep").agg(*[F.sum(F.col("m") * F.col(f"{c}{s}")).alias(f"{c}{s}") for c in ("answered", "wrong", "right", "refused") for s in sides])
    values = {}
    for s in sides:
        values |= {f"wrong_citation_rate{s}": rate(F.col(f"wrong{s}"), F.col(f"answered{s}")), f"right{s}": F.col(f"right{s}").cast("double"), f"refused{s}": F.col(f"refused{s}").cast("double")}
    shown = {k: v for k, v in values.items() if not k.endswith("_b")}
    if other is not None:
        shown |= {f"delta_{k}": values[k] - values[f"{k}_b"] for k in list(shown)}
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in shown.items()])).alias("x")).select("x.metric", "x.v")
    at = lambda q: F.round(F.get("s", F.lit(int(q * (reps - 1)))), 3)
    return long.groupBy("metric").agg(F.sort_array(F.collect_list("v")).alias("s")).select("metric", at(0.025).alias("low"), at(0.975).alias("high"))  # reps numbers


def learning(questions: DataFrame, before: DataFrame, after: DataFrame, floor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one pass of learning changed: ``system, n_answered, n_wrong, n_right, n_refused`` of the second
    week's questions before and after it and for a baseline, and the intervals of after less before.
    All answers are ``qid, cited, score``."""
    parts = [summary(graded(questions, a)).withColumn("system", F.lit(name)) for name, a in (("before", before), ("after", after), ("baseline", floor))]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("system", "n", "n_answered", "n_wrong", "n_right", "n_refused", "wrong_rate")
    deltas = bootstrap(graded(questions, after), graded(questions, before)).where("metric like 'delta%'")
    return table, deltas


def question_pairs(questions: DataFrame) -> DataFrame:
    """``intent, week, qid``: questions of one gold page are one intent asked twice (its first two); one
    without a page is asked twice in the same words."""
    w = W.partitionBy("gold").orderBy("qid")
    told = questions.where("gold is not null").withColumn("week", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy("gold"))).where("_n >= 2 and week <= 2").select(F.col("gold").cast("string").alias("intent"), "week", "qid")
    none = questions.where("gold is null").select(F.col("qid").cast("string").alias("intent"), F.explode(F.array(F.lit(1), F.lit(2))).alias("week"), "qid")
    return told.unionByName(none)


def against_matched(grades_of, answers: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two systems at equal coverage: the other one keeps as many answers as the first gives, those with
    the highest scores. ``grades_of`` grades answers."""
    n = answers.where("cited is not null").count()
    return grades_of(answers), grades_of(at_coverage(other, n))


def percentile(values: DataFrame, column: str, q: float) -> DataFrame:
    """An order statistic without interpolation, by rank and count; nulls come first. Equal values are one
    row with their number, so ties need no order."""
    each = values.groupBy(column).agg(F.count("*").alias("_n"))
    at = int(values.count() * q) + 1
    run = running(each, [F.asc(column)], {"_upto": F.col("_n")})
    return run.where((F.col("_upto") >= at) & (F.col("_upto") - F.col("_n") < at)).select(F.col(column).alias("value"))


def captured(pairs: DataFrame, gold: DataFrame, lines: DataFrame) -> DataFrame:
    """One row of capture scores: ``hits`` (the smaller count of distinct sides of the matched ``pairs(g, s)``),
    ``missed`` of ``gold(g, is_change)``, ``wrong`` of ``lines(s)``, and how many changes were caught."""
    hits = pairs.agg(F.least(F.countDistinct("g"), F.countDistinct("s")).alias("hits"))
    wanted = gold.agg(F.countDistinct("g").alias("n_gold"), F.countDistinct(F.when(F.col("is_change"), F.col("g"))).alias("n_changes"))
    found = lines.agg(F.countDistinct("s").alias("n_lines"))
    caught = gold.where("is_change").join(pairs.select("g").distinct(), "g").agg(F.countDistinct("g").alias("changes"))
    share = lambda n: F.round(1 - F.coalesce(F.try_divide(F.col("hits"), F.col(n)), F.lit(0.0)), 3)
    one = hits.crossJoin(wanted).crossJoin(found).crossJoin(caught)  # one row each
    return one.select("hits", "n_gold", "n_lines", share("n_gold").alias("missed"), share("n_lines").alias("wrong"), "changes", "n_changes")


def judged_by_month(rows: DataFrame) -> DataFrame:
    """Mean points of ``judged`` rows with a ``day``, by month and over all."""
    out = judged(rows).withColumn("month", F.date_format("day", "yyyy-MM")).rollup("month").agg(F.count("*").alias("n"), F.round(F.avg("points"), 3).alias("points"))
    return out.withColumn("month", F.coalesce("month", F.lit("all")))


def judged(rows: DataFrame) -> DataFrame:
    """Judge scores of ``rows(qid, refused, existed, valid, first, second)``: a refusal is worth 0
    if there was an answer, else 2; a citation is worth 0 if there was none, else the mean of
    both passes."""
    points = F.when(F.col("refused"), F.when(F.col("existed"), 0.0).otherwise(2.0)).when(~F.col("existed") | ~F.col("valid"), 0.0).otherwise((F.col("first") + F.col("second")) / 2)
    return rows.withColumn("points", points)


def judge_points(refused: Column, existed: Column, invalid: Column, points: Column) -> Column:
    """Of one pass: a refusal is worth 2 if no answer existed, else 0; without an answer or with citations
    that are all invalid 0; else 0, 1 or 2, as judged (anything else is 0)."""
    return F.when(refused, F.when(existed, 0).otherwise(2)).when(invalid | ~existed, 0).when(points.isin(0, 1, 2), points).otherwise(0).cast("int")


def duel(verdicts: DataFrame, a: str, b: str, reps: int | None = 10_000, seed: int = 0, order: str = "qid") -> DataFrame:
    """Two systems by a judge's ``verdicts(qid, day, system, pass, refused, existed, invalid, points)``: by month and
    over ``all``, ``n`` questions that both have verdicts of, the means of their means over passes, and the
    share of all questions for which an answer existed (by the first pass; of equal ones, not if one of them says so). ``low, high``: the middle 95 % of
    the mean difference over resamples of the questions from one stream of the standard generator, of
    all months together; with ``reps`` None there are no such columns."""
    point = judge_points(F.col("refused"), F.col("existed"), F.col("invalid"), F.col("points"))
    of = lambda name: F.avg(F.when(F.col("system") == name, point))
    first = F.min_by("existed", F.struct("pass", "system", "existed"))
    each = verdicts.groupBy("qid").agg(F.min(F.date_format("day", "yyyy-MM")).alias("month"), of(a).alias("_a"), of(b).alias("_b"), first.cast("int").alias("_e"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(both, F.col(c))), 3)
    out = each.rollup("month").agg(F.grouping("month").alias("_g"), F.count(F.when(both, 1)).alias("n"), mean("_a").alias("mean_a"), mean("_b").alias("mean_b"), F.round(F.avg("_e"), 3).alias("existed"))
    out = out.withColumn("month", F.when(F.col("_g") == 1, "all").otherwise(F.col("month"))).where("_g = 1 or n > 0")
    if reps is None:
        return out.drop("_g")
    diffs = each.where(both).select((F.row_number().over(W.orderBy(order)) - 1).alias("pos"), (F.col("_a") - F.col("_b")).alias("d"))  # a question set, of bounded size
    spark, n = verdicts.sparkSession, diffs.count()
    if not n:
        return out.drop("_g").withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    times = draws(spark, n, reps, seed).groupBy("rep", "pos").agg(F.count("*").alias("m"))
    means = times.join(diffs, "pos").groupBy("rep").agg((F.sum(F.col("m") * F.col("d")) / n).alias("v"))
    at = lambda i: F.round(F.get("s", F.lit(i)), 3)
    bounds = means.agg(F.sort_array(F.collect_list("v")).alias("s")).select(F.lit(1).cast("tinyint").alias("_g"), at(int(0.025 * reps)).alias("low"), at(int(0.975 * reps) - 1).alias("high"))  # reps numbers
    return out.join(F.broadcast(bounds), "_g", "left").drop("_g")


def unsound(questions: DataFrame, pages: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """``qid, problem`` of ``questions(qid, q, gold)``: repeats and gold pages that are not there. With columns
    ``evidence`` and ``absent``, a quote that must stand on the gold page and a word that must stand on
    no page; with ``status`` in ``pages(rel, body, status)``, a gold page that is dead; with ``counts`` and a
    column ``kind``, kinds of another size (``qid`` null)."""
    from recollect.operators.index import DEAD

    kind = questions.schema["qid"].dataType
    same = questions.withColumn("n", F.count("*").over(W.partitionBy(F.lower(F.trim("q"))))).where("n > 1").select("qid", F.lit("repeated").alias("problem"))
    told = questions.where("gold is not null")
    out = same.unionByName(told.join(pages.select(F.col("rel").alias("gold")), "gold", "left_anti").select("qid", F.lit("gold is missing").alias("problem")))
    on = told.join(pages.withColumnRenamed("rel", "gold"), "gold")
    if "evidence" in questions.columns:
        out = out.unionByName(on.where(F.col("evidence").isNotNull() & ~F.contains("body", F.col("evidence"))).select("qid", F.lit("evidence is not on the page").alias("problem")))
    if "absent" in questions.columns:
        from recollect.functions import text as T

        words = pages.select(F.explode(F.array_distinct(T.latin_words(F.col("body"), 0))).alias("absent")).distinct()
        out = out.unionByName(questions.where("absent is not null").withColumn("absent", F.lower("absent")).join(words, "absent", "left_semi").select("qid", F.lit("the absent word is on a page").alias("problem")))
    if "status" in pages.columns:
        out = out.unionByName(on.where(F.lower("status").isin(*DEAD)).select("qid", F.lit("gold is dead").alias("problem")))
    if counts:
        want = questions.sparkSession.createDataFrame(list(counts.items()), "kind string, want long")
        off = want.join(questions.groupBy("kind").agg(F.count("*").alias("n")), "kind", "full_outer").where(~F.col("want").eqNullSafe(F.col("n")))
        out = out.unionByName(off.select(F.lit(None).cast(kind).alias("qid"), F.concat(F.lit("another number of "), "kind").alias("problem")))
    return out


def leave_one_out(grades: DataFrame, cuts: DataFrame) -> DataFrame:
    """``left_out, floor, points``: the sweep of floors with each question left out in turn. A
    question changes a floor's points by its own share, so nothing is swept again."""
    total = floors(grades, cuts).select("floor", "points")
    own = F.when(F.col("answered") & (F.col("score") >= F.col("floor")), F.when(F.col("right"), 1).otherwise(-1)).otherwise(0)
    each = grades.select("qid", "answered", "right", "score").crossJoin(F.broadcast(total))  # a question set and a list of floors
    return each.select(F.col("qid").alias("left_out"), "floor", (F.col("points") - own).alias("points"))


def hinge(items: DataFrame, floors: list[float]) -> DataFrame:
    """Whether it hangs on one item that no floor does as well as the lock: ``dropped, part, score, inverted,
    still_no_floor`` for each rewrite and negative of ``items(id, slice, kind, gold, score, pred)`` that is left out in
    turn. ``inverted`` rewrites score less than the best negative.

    A floor does as well if every hit is answered and right, and nothing that is wrong is answered: it
    lies above the highest score of those that would be wrong, and not above the lowest of the hits. Leaving
    one item out moves such an end to the next score at most, so two of each tell all sweeps at once."""
    some = items.select("id", "slice", "kind", "gold", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), "pred")
    at = place(items.sparkSession, "items")
    some.write.parquet(at)  # ranked once, looked at several times
    some = items.sparkSession.read.schema(some.schema).parquet(at)
    right = F.col("pred").isNotNull() & F.col("pred").eqNullSafe(F.col("gold"))
    wrong, hit = some.where(F.col("pred").isNotNull() & ~right), some.where("slice = 'hit'")
    high = [(r["id"], r["score"]) for r in wrong.orderBy(F.desc("score"), "id").select("id", "score").limit(2).collect()]
    low = [(r["id"], r["score"]) for r in hit.orderBy("score", "id").select("id", "score").limit(2).collect()]
    lost = [r["id"] for r in hit.where(~right).select("id").limit(2).collect()]
    best = some.where("slice = 'negative'").agg(F.max("score")).first()[0]

    def end(pair: list, none: float) -> Column:
        """The first of two scores without the dropped item."""
        out = F.lit(float(pair[-1][1]) if len(pair) > 1 else none)
        return F.when(F.col("id") == pair[0][0], out).otherwise(F.lit(float(pair[0][1]))) if pair else F.lit(none)

    above, upto = end(high, -math.inf), end(low, math.inf)
    left = F.lit(len(lost)) - (F.when(F.col("id").isin(lost), 1).otherwise(0) if lost else F.lit(0))
    fits = F.exists(F.array(*[F.lit(float(f)) for f in floors]), lambda f: (f > above) & (f <= upto)) & (left == 0)
    part = F.when(F.col("kind") == "rewrite", "rewrite").when(F.col("slice") == "negative", "negative")
    inverted = (part == "rewrite") & (F.col("score") < F.lit(0.0 if best is None else best))
    return some.withColumn("part", part).where("part is not null").select(F.col("id").alias("dropped"), "part", "score", inverted.alias("inverted"), (~fits).alias("still_no_floor"))


def slices_exact(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Per slice and overall: exact, neighbour, old-page, trapped and missed rates of
    ``items(id, slice, gold, old, trap)`` and ``answers(id, cited)``; a miss is right without gold."""
    j = items.join(answers, "id", "left")
    miss = F.col("cited").isNull()
    flags = {
        "exact": F.when(F.col("gold").isNull(), miss).otherwise(F.coalesce(F.col("cited") == F.col("gold"), F.lit(False))),
        "false_neighbor": ~miss & ~F.col("cited").eqNullSafe(F.col("gold")),
        "old_page": F.col("old").isNotNull() & F.coalesce(F.col("cited") == F.col("old"), F.lit(False)),
        "trapped": F.col("trap").isNotNull() & F.coalesce(F.col("cited") == F.col("trap"), F.lit(False)),
        "miss": miss,
    }
    out = j.rollup("slice").agg(F.count("*").alias("n"), *[rate(F.sum(c.cast("int")), F.count("*"), 4).alias(k) for k, c in flags.items()])
    return out.withColumn("slice", F.coalesce("slice", F.lit("all")))


def matches_lock(summary: DataFrame) -> DataFrame:
    """Whether a system does as well as the lock: every hit exact, every negative missed, no
    false neighbour."""
    at = lambda s, c: F.max(F.when(F.col("slice") == s, F.col(c)))
    return summary.agg(((at("hit", "exact") == 1) & (at("negative", "miss") == 1) & (at("all", "false_neighbor") == 0)).alias("matches"))


def rewrite_check(nouns: DataFrame, paraphrases: DataFrame, hits) -> DataFrame:
    """``kind, n, ok``: all nouns must hit their page and all paraphrases must miss; ``hits`` maps
    questions ``qid, q`` to ``qid, source``."""
    a = nouns.join(hits(nouns.select("qid", "q")), "qid", "left").select(F.lit("noun").alias("kind"), F.coalesce(F.col("source") == F.col("gold"), F.lit(False)).alias("ok"))
    b = paraphrases.join(hits(paraphrases.select("qid", "q")), "qid", "left").select(F.lit("paraphrase").alias("kind"), F.col("source").isNull().alias("ok"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("ok"))
