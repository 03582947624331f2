"""The inverted index: document rows, postings, vocabulary, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T

# Statuses of pages that no longer hold, and rank weights by tier.
DEAD = ("superseded", "retired", "rejected", "deprecated", "archived")
TIER_BOOST = {"rule": 1.6, "topic": 1.4, "project": 1.0, "other": 0.9, "log": 0.8, "dead": 0.25}


def tier_of(path: Column, status: Column, prefixes: list[tuple[str, str]], generated: Column | None = None) -> Column:
    """The tier of a page: dead by status, else by the first prefix that fits, else ``other``."""
    dead = F.lower(F.coalesce(status, F.lit(""))).isin(*DEAD)
    out = F.when(dead | generated if generated is not None else dead, "dead")
    for prefix, tier in prefixes:
        out = out.when(path.startswith(prefix), tier)
    return out.otherwise("other")


def boost(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIER_BOOST.items() for x in kv]), tier)


def document_rows(pages: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """Index rows ``rel, title, triggers, body, uni, status, how, name`` (tokens) of
    ``pages(rel, meta, body)``; ``triggers(rel, words array)`` adds words by page."""
    stem = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), "\\.md$", "")
    title, terms = F.coalesce(F.col("meta")["title"], F.lit("")), F.coalesce(F.col("meta")["topic_terms"], F.lit(""))
    own = F.coalesce(F.col("meta")["triggers"], F.col("meta")["aliases"], F.lit(""))
    if triggers is not None:
        pages = pages.join(triggers.withColumnRenamed("words", "_words"), "rel", "left")
        own = F.concat_ws(" ", own, F.array_join(F.coalesce("_words", F.array().cast("array<string>")), " "))
    folders = F.regexp_replace("rel", "/?[^/]*$", "")
    return pages.select(
        "rel",
        T.tokens(F.concat_ws(" ", title, stem, terms)).alias("title"),
        T.tokens(own).alias("triggers"),
        T.tokens(F.concat_ws(" ", F.regexp_replace(folders, "/", " "), "body")).alias("body"),
        T.unigrams(F.concat_ws(" ", title, stem, "body")).alias("uni"),
        F.lower(F.coalesce(F.col("meta")["status"], F.lit(""))).alias("status"),
        T.first_rule_line(F.col("body")).alias("how"),
        F.concat_ws("|", T.compact(title), T.compact(stem), T.compact(terms)).alias("name"),
    )


def postings(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, term, tf`` of token arrays; counted before the shuffle."""
    def entries(field: str) -> Column:
        return F.transform(F.col(field), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    some = F.flatten(F.array(*[entries(f) for f in fields]))
    return rows.select(key, F.explode(some).alias("p")).groupBy(key, "p.field", "p.term").agg(F.count("*").alias("tf"))


def vocabulary(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``term, df``: in how many rows a term occurs."""
    return rows.select(key, F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mark: list[str], digest_changed: bool = False) -> DataFrame:
    """``key, state`` (added, changed, removed, unchanged): rows are the same while all of
    ``mark`` are; if the alias digest has changed, every known row is dirty."""
    a = old.select(key, F.struct(*mark).alias("_old"))
    b = new.select(key, F.struct(*mark).alias("_new"))
    same = F.lit(False) if digest_changed else F.col("_old") == F.col("_new")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def refreshed(index: DataFrame, fresh: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """The index after a refresh: untouched rows stay, fresh ones replace what changed."""
    keep = index.join(diff.where("state = 'unchanged'").select(key), key, "left_semi")
    put = fresh.join(diff.where("state in ('added', 'changed')").select(key), key, "left_semi")
    return keep.unionByName(put)


def alias_words(*maps: DataFrame) -> DataFrame:
    """``rel, words`` from several tables of ``rel, words array``."""
    both = maps[0]
    for m in maps[1:]:
        both = both.unionByName(m)
    return both.groupBy("rel").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
