"""Upkeep reports: links, supersede edges and their order, usage, health, budgets, steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import redact

# States of a step, the worst first.
SEVERITY = ["failed", "skipped", "degraded", "ok"]


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``links(src, target)`` whose target is no page, neither by path nor by stem."""
    paths = pages.select(F.col("rel").alias("target"))
    names = pages.select(F.regexp_replace("rel", "\\.md$", "").alias("target")).union(pages.select(F.regexp_replace(F.element_at(F.split("rel", "/"), -1), "\\.md$", "")))
    return links.join(paths.union(names).distinct(), "target", "left_anti")


def supersede_edges(pages: DataFrame) -> DataFrame:
    """``new, old`` from the heads' lists in both directions."""
    refs = lambda c: F.explode(F.filter(F.transform(F.split(F.regexp_replace(c, "[\\[\\]\"]", ""), "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))
    a = pages.select(F.col("rel").alias("new"), refs(F.coalesce(F.col("meta")["supersedes"], F.lit(""))).alias("old"))
    b = pages.select(refs(F.coalesce(F.col("meta")["superseded_by"], F.lit(""))).alias("new"), F.col("rel").alias("old"))
    full = lambda x: F.when(x.endswith(".md"), x).otherwise(F.concat(x, F.lit(".md")))
    return a.unionByName(b).select(full(F.col("new")).alias("new"), full(F.col("old")).alias("old")).distinct()


def tenure(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """``new, old, new_rank, old_rank, ok`` for rankings ``qid, key, rank`` in which the question
    is the old page's title (``qid`` = old): the new page must stand before the old one."""
    rank = lambda who: ranked.select(F.col("qid").alias("old"), F.col("key").alias(who), F.col("rank").alias(f"{who}_rank"))
    out = edges.join(rank("new"), ["old", "new"], "left")
    own = ranked.where("qid = key").select(F.col("qid").alias("old"), F.col("rank").alias("old_rank"))
    out = out.join(own, "old", "left")
    return out.select("new", "old", "new_rank", "old_rank", (F.col("new_rank").isNotNull() & (F.col("old_rank").isNull() | (F.col("new_rank") < F.col("old_rank")))).alias("ok"))


def unused(pages: DataFrame, usage: DataFrame, since: str, today: str) -> DataFrame:
    """Pages that ``usage(rel, day)`` does not name within a window."""
    used = usage.where(F.col("day").between(F.lit(since).cast("date"), F.lit(today).cast("date"))).select("rel")
    return pages.join(used, "rel", "left_anti")


def demand(usage: DataFrame, key: str) -> DataFrame:
    return usage.groupBy(key).agg(F.count("*").alias("n"))


def worst(steps: DataFrame, key: str, state: str = "state") -> DataFrame:
    """The worst state of each key."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(state))
    return steps.groupBy(key).agg(F.get(F.array(*[F.lit(s) for s in SEVERITY]), (F.min(rank) - 1).cast("int")).alias("state"))


def outcome(output: Column, exit_code: Column) -> Column:
    """The state of a step from what it printed."""
    return F.when(output.rlike("(?i)\\bskipped\\b|no model"), "skipped").when(exit_code != 0, "failed").when(output.rlike("(?i)\\b(error|failed|degraded|warning)\\b"), "degraded").otherwise("ok")


def standing_index(aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, source, anchor, names, how``: one row per live alias row, with its page's rule."""
    names = aliases.groupBy("id", "source", "anchor").agg(F.array_join(F.sort_array(F.collect_list("alias")), ", ").alias("names"))
    return names.join(pages.select(F.col("rel").alias("source"), "how"), "source").select("id", "source", "anchor", "names", F.coalesce(F.when(F.col("how") != "", F.col("how")), F.col("anchor")).alias("how"))


def gather(lines: DataFrame, terms: DataFrame, per_page: int = 12, budget: int = 30_000) -> DataFrame:
    """Evidence of each topic: ``topic, rel, line_no, line`` of ``lines(rel, day, line_no, line)``
    that hold one of its ``terms(topic, term)``, most hit pages first, newest first among
    equals, whole lines within a character budget. Topic terms are a maintained list."""
    hit = lines.join(F.broadcast(terms.select("topic", F.lower("term").alias("term"))), F.contains(F.lower("line"), F.col("term"))).select("topic", "rel", "day", "line_no", "line").distinct()
    first = hit.withColumn("_r", F.row_number().over(W.partitionBy("topic", "rel").orderBy("line_no"))).withColumn("_n", F.count("*").over(W.partitionBy("topic", "rel"))).where(F.col("_r") <= per_page)
    w = W.partitionBy("topic").orderBy(F.desc("_n"), F.desc("day"), "rel", "line_no").rowsBetween(W.unboundedPreceding, 0)
    return first.withColumn("_sum", F.sum(F.length("line")).over(w)).where(F.col("_sum") <= budget).select("topic", "rel", "line_no", "line")


def changed_evidence(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """Topics whose evidence digest is not the one known: ``topic, sha``."""
    order = F.struct("rel", "line_no", "line")
    sha = F.substring(F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]), "\n").cast("binary")), 1, 16)  # within the budget
    return evidence.groupBy("topic").agg(sha.alias("sha")).join(known.select("topic", "sha"), ["topic", "sha"], "left_anti")


def weak_queries(log: DataFrame, since: str, k: int = 40) -> DataFrame:
    """Questions without a sure answer after a cursor, each once, the first first."""
    weak = log.where((F.col("ts") > F.lit(since)) & F.col("confidence").isin("none", "low"))
    once = weak.groupBy("q").agg(F.min("ts").alias("ts"))
    return once.orderBy("ts", "q").limit(k)


def merged_pages(fresh: DataFrame, present: DataFrame, mark: str) -> DataFrame:
    """``rel, content, state`` of an idempotent write: foreign pages (without our mark) are kept,
    equal ones are the same, others are written."""
    old = present.select("rel", F.col("content").alias("_old"))
    state = F.when(F.col("_old").isNull(), "written").when(~F.contains("_old", F.lit(mark)), "kept").when(F.col("_old") == F.col("content"), "same").otherwise("written")
    j = fresh.join(old, "rel", "left").withColumn("state", state)
    return j.withColumn("content", F.when(F.col("state") == "kept", F.col("_old")).otherwise(F.col("content"))).drop("_old")


def safe_files(files: DataFrame, most: int = 8, size: int = 60_000) -> DataFrame:
    """``files(path, content)`` a model proposed, with ``reason`` where one is not to be applied."""
    order = W.orderBy("path")  # of one proposal
    reason = (
        F.when(F.col("path").startswith("/") | F.col("path").rlike("(^|/)\\.\\.(/|$)"), "outside the folder")
        .when(~F.col("path").endswith(".md"), "not a page")
        .when(F.col("path").startswith("Clippings/"), "not to be changed")
        .when(F.length("content") > size, "too large")
        .when(F.row_number().over(order) > most, "too many")
    )
    return files.withColumn("reason", reason)


def ledger_check(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """``rel, state`` of ``ledger(rel, sha)`` against ``files(rel, content)``: verified, mismatch
    or missing."""
    have = files.select("rel", F.sha2(F.col("content").cast("binary"), 256).alias("_sha"))
    state = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha") == F.col("_sha"), "verified").otherwise("mismatch")
    return ledger.join(have, "rel", "left").select("rel", state.alias("state"))


def without_secret_hits(hits: DataFrame, secret: DataFrame) -> DataFrame:
    """Lines of a search, ``path.md:NN:`` or, beside a match, ``path.md-NN-`` and text, whose page is not
    among ``secret(rel)``, redacted; other lines are only redacted."""
    page = F.regexp_extract("line", "^(.*?\\.md)[:-][0-9]+[:-]", 1)
    kept = hits.withColumn("_p", page).join(secret.select(F.col("rel").alias("_p")).distinct(), "_p", "left_anti").drop("_p")
    return kept.withColumn("line", redact.redact(F.col("line")))


def pending_days(days: DataFrame, stubs: DataFrame) -> DataFrame:
    """Days for which a stub is to be written: those that have none yet."""
    return days.select("day").distinct().join(stubs.select("day"), "day", "left_anti")
