"""Evidence of topics: the pages of authority, then excerpts of pages by hits, then of logs by day, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.operators.literal import Grams, Scan

# What a block says of where it is from.
KINDS = ["权威页", "页面", "时间日志"]

#: Characters of a page of authority, of an excerpt and of all evidence of a topic; hits that an excerpt shows.
WHOLE, EXCERPT, BUDGET, HITS = 3500, 1800, 30_000, 12
#: Parts of a topic's pages that are ranked by themselves before all of it is.
PARTS = 64


def excerpt(lines: Column, at: Column, hits: int = HITS, size: int = EXCERPT) -> Column:
    """The first hits ``at`` (from 0) of some lines with a line around each, every line once, without blank ones."""
    near = F.array_distinct(F.flatten(F.transform(F.slice(at, 1, hits), lambda i: F.array(i - 1, i, i + 1))))
    shown = F.transform(F.array_sort(F.filter(near, lambda j: (j >= 0) & (j < F.size(lines)))), lambda j: F.get(lines, j))
    return F.substring(F.array_join(F.filter(shown, lambda x: x.rlike("\\S")), "\n"), 1, size)


def evidence(grams: Grams | Scan, pages: DataFrame, text: Column, terms: DataFrame, authority: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``topic, place, key, kind, block, upto`` of ``pages(key, day, ..)``, a page with a ``day`` being a log.

    ``terms(topic, term)`` are found in any case within lines, by reading the pages or by their rarest trigrams
    (``grams`` of the pages); a page of ``authority(topic, key)`` is taken as it begins, whether it has a term or not.
    Authorities stand in the order of key, pages by their number of hits, then key, logs by day, then key, the
    greatest first. ``upto`` is the length of the blocks up to this one; the first that passes
    the budget ends a topic's evidence. Null texts are empty; a topic without terms has its authorities only.

    What passes the budget among some of a topic's pages passes it among all of them, so the pages of a topic
    are ranked in parts first, and a task gets from each part what fits into the budget and one page more."""
    key = grams.key
    own = authority.select("topic", key).distinct()
    body = F.coalesce(text, F.lit(""))
    page = pages.select(key, F.col("day").cast("string").alias("day"), body.alias("_t"))
    asked = terms.select(F.col("topic").alias("qid"), F.lower("term").alias("needle")).where("needle <> '' and instr(needle, '\n') = 0").distinct()
    near = grams.candidates(asked).groupBy(F.col("qid").alias("topic"), key).agg(F.collect_set("needle").alias("needles"))
    lined = near.join(own, ["topic", key], "left_anti").join(page.select("*", F.split("_t", "\n").alias("lines")), key)
    low = F.transform("lines", lambda x: F.lower(x))
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.exists("needles", lambda n: F.contains(F.get(F.col("_low"), i), n)))
    hit = lined.withColumn("_low", low).withColumn("at", at).where(F.size("at") > 0)
    log = F.col("day").isNotNull()
    found = hit.select("topic", key, "day", F.when(log, 2).otherwise(1).alias("k"), F.when(log, 0).otherwise(F.size("at")).alias("hits"), excerpt(F.col("lines"), F.col("at")).alias("body"))
    told = own.join(page, key).select("topic", key, "day", F.lit(0).alias("k"), F.lit(0).alias("hits"), F.substring("_t", 1, WHOLE).alias("body"))
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), F.col("k"))
    head = F.concat(F.lit("### ["), kind, F.when(F.col("k") == 2, F.concat(F.lit(" "), "day")).otherwise(""), F.lit("] "), F.col(key).cast("string"), F.lit("\n"))
    every = found.unionByName(told).withColumn("block", F.concat(head, "body")).withColumn("kind", kind)
    first = F.when(F.col("k") == 0, F.col(key))  # authorities go up by key, all others down
    order = ["k", first, F.desc("hits"), F.desc(F.when(F.col("k") == 2, F.col("day"))), F.desc(key)]
    total = lambda *by: F.sum(F.length("block")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    parted = every.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    # With the first that passes the budget, which ends the evidence.
    few = parted.withColumn("upto", total("topic", "_part")).where(F.col("upto") - F.length("block") <= budget)
    ranked = few.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy(*order))).withColumn("upto", total("topic"))
    return ranked.where(F.col("upto") <= budget).select("topic", "place", key, "kind", "block", "upto")
