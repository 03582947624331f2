"""The alias lock: exact names pinned to one page, with validity, conflicts and suggestions.

Questions and aliases are compared by containment; pairs that may fit are found by equality
joins on what is rarest in the shorter form, so no table is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import lock_form
from recollect.plans.place import place

LOCK_BAND = 100
#: Triggers up to which they are sent to every task.
FEW_TRIGGERS = 50_000


def in_force(valid_from: Column, invalid_at: Column, today: Column, status: Column | None = None) -> Column:
    """Valid since some day up to today, not yet invalid, and not dead."""
    from recollect.operators.index import DEAD

    ok = (valid_from.isNull() | (valid_from <= today)) & (invalid_at.isNull() | (today < invalid_at))
    return ok if status is None else ok & ~F.lower(F.coalesce(status, F.lit(""))).isin(*DEAD)


def live_rows(aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``aliases(id, source, ...)`` whose page is there."""
    return aliases.join(pages.select(F.col("rel").alias("source")), "source", "left_semi")


def carries(alias: Column, query: Column) -> Column:
    """Whether an alias inside a question is long enough to decide it."""
    return (F.length(alias) >= 4) | (2 * F.length(alias) >= F.length(query))


def stands_in_for(query: Column, alias: Column) -> Column:
    """Whether a question inside an alias is long enough to mean it."""
    plain = query.rlike("^[\\x00-\\x7f]*$")
    return F.when(plain, (F.length(query) >= 4) & (2 * F.length(query) >= F.length(alias))).otherwise(F.length(query) >= 2)


def alias_score(query: Column, alias: Column) -> Column:
    """Of normal forms: 1000 and the length if equal; 500 for an alias in the question (60 if
    short); 100 for a question in the alias."""
    a, q = F.length(alias), F.length(query)
    return (
        F.when((a == 0) | (q == 0), 0)
        .when(alias == query, 1000 + a)
        .when(F.contains(query, alias), F.when(carries(alias, query), 500 + a).otherwise(60 + a))
        .when(F.contains(alias, query) & stands_in_for(query, alias), 100 + q)
        .otherwise(0)
    )


def near_score(query: Column, alias: Column) -> Column:
    """The alias score if there is one; else, of forms of two characters or more, a common beginning
    of two or more, or two shared characters or more."""
    n = F.least(F.length(query), F.length(alias))
    prefix = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substring(query, i, F.lit(1)) == F.substring(alias, i, F.lit(1))), i).otherwise(s))
    shared = F.size(F.array_intersect(F.split(query, ""), F.split(alias, "")))
    hit = alias_score(query, alias)
    return F.when(hit > 0, hit).when(n < 2, 0).when(prefix >= 2, 40 + prefix).when(shared >= 2, 20 + shared).otherwise(0)


def _grams(text: Column, n: int) -> Column:
    size = F.length(text)
    return F.when(size < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))))


def _held(df: DataFrame, name: str) -> DataFrame:
    """Written and read back, as several joins start from it."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _names(aliases: DataFrame) -> DataFrame:
    return _held(aliases.select("id", "source", "alias", lock_form(F.col("alias")).alias("_a")).where("_a <> ''").withColumn("_row", F.xxhash64("id", "source", "alias")), "names")


def _holding(q: DataFrame, names: DataFrame) -> DataFrame:
    """``_q`` of ``q(_q)`` and the rows of names of which one holds the other, and some more: both have the
    rarest two characters of the shorter one (or its only one), by how many names have them."""
    both = lambda c: F.array_distinct(F.concat(_grams(F.col(c), 1), _grams(F.col(c), 2)))
    # Spark takes what is exploded for no larger than it was before, and would send it to every task.
    within = names.select("_row", "_a", F.explode(both("_a")).alias("_k")).hint("merge")
    df = within.groupBy("_k").agg(F.count("*").alias("_df"))
    long = lambda c: F.length("_k") == F.least(F.lit(2), F.length(c))
    rarest = F.min_by("_k", F.struct("_df", "_k")).alias("_k")
    own = within.where(long("_a")).join(df, "_k").groupBy("_row").agg(rarest)
    asked = q.select("_q", F.explode(both("_q")).alias("_k")).hint("merge")
    # Two characters that no name has are in the question all the same: no name holds it.
    short = asked.where(long("_q")).join(df, "_k", "left").groupBy("_q").agg(F.min_by("_k", F.struct(F.coalesce("_df", F.lit(0)), "_k")).alias("_k"))
    inside = asked.join(own, "_k").select("_q", "_row")
    around = short.join(within.select("_row", "_k"), "_k").select("_q", "_row")
    return inside.unionByName(around).distinct()


def _best(pairs: DataFrame, names: DataFrame, score, least: int) -> DataFrame:
    """``_q, id, source, alias, score`` of pairs ``_q, _row``: the best alias of each row of the table."""
    some = pairs.join(names, "_row").withColumn("score", score(F.col("_q"), F.col("_a"))).where(F.col("score") >= least)
    best = F.max(F.struct(F.col("score"), -F.length("alias"), F.col("alias"))).alias("b")
    return some.groupBy("_q", "id", "source").agg(best).select("_q", "id", "source", F.col("b.alias").alias("alias"), F.col("b.score").alias("score"))


def scores(queries: DataFrame, aliases: DataFrame, score=alias_score, least: int = LOCK_BAND) -> DataFrame:
    """``qid, id, source, alias, score``: the best alias of each row per question, if it has
    ``least`` points. ``queries(qid, q)``; ``aliases(id, alias, source)``, one alias a row. Who holds whom
    is found by the rarest two characters of the shorter one."""
    q = _held(queries.select("qid", lock_form(F.col("q")).alias("_q")).where("_q <> ''"), "asked")
    names = _names(aliases)
    found = _best(_holding(q.select("_q").distinct(), names), names, score, least)
    return q.join(found, "_q").select("qid", "id", "source", "alias", "score")


def pick(scored: DataFrame) -> DataFrame:
    """``qid, id, source, score``: the only winner, or the lowest id among equals on one page."""
    top = scored.withColumn("r", F.rank().over(W.partitionBy("qid").orderBy(F.desc("score")))).where("r = 1")
    return top.groupBy("qid").agg(F.min("id").alias("id"), F.min("source").alias("source"), F.max("source").alias("_other"), F.max("score").alias("score")).where("source = _other").drop("_other")


def by_tokens(queries: DataFrame, aliases: DataFrame, least: int = 500, several: bool = True) -> DataFrame:
    """For questions of several words: the sum of each row's scores over the single words."""
    some = queries.where(F.trim("q").rlike("\\s")) if several else queries
    words = some.select("qid", F.posexplode(F.split(F.trim("q"), "\\s+")).alias("_n", "q")).select(F.struct("qid", "_n").alias("qid"), "q")
    each = scores(words, aliases, least=least)
    return each.groupBy(F.col("qid.qid").alias("qid"), "id", "source").agg(F.sum("score").alias("score"))


def locked(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """The lock: by the whole question, else by its words."""
    first = pick(scores(queries, aliases))
    rest = queries.join(first, "qid", "left_anti")
    return first.unionByName(pick(by_tokens(rest, aliases)))


def suggestions(queries: DataFrame, aliases: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest names of each question, by near score and id.

    Names that hold the question or are held by it are found as in ``scores``. Of the names with a common
    beginning the ``k`` lowest ids are enough, for every length of it. Names that share at least t
    characters with a question of m share two of its m - t + 2 rarest ones: t goes down from m, each time for
    the questions of which the k-th best name could still be beaten by one that shares fewer. The last
    step, t = 2, needs no more than the lowest ids for any two characters, as all that share just these
    two are equal."""
    q = _held(queries.select("qid", lock_form(F.col("q")).alias("_q")).where("_q <> ''"), "asked")
    names, one = _names(aliases), q.select("_q").distinct()
    order = [F.desc("score"), F.asc("id")]
    lowest = lambda df, by, n: df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("id", "_row"))).where(F.col("_r") <= n).drop("_r")

    begins = lambda c: F.explode(F.transform(F.sequence(F.lit(2), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))).alias("_k")
    heads = names.where(F.length("_a") >= 2).select("id", "_row", begins("_a"))
    # Rows of one id count once; each of its aliases has a row of its own, so the lowest of each id is kept.
    heads = lowest(heads.groupBy("_k", "id").agg(F.min("_row").alias("_row")), ["_k"], k)
    first = one.where(F.length("_q") >= 2).select("_q", begins("_q")).join(heads, "_k").select("_q", "_row")
    best = _held(_best(_holding(one, names).unionByName(first).distinct(), names, near_score, 1), "near")

    chars = lambda c: F.array_distinct(F.filter(F.split(F.col(c), ""), lambda x: x != ""))
    df = names.select(F.explode(chars("_a")).alias("c")).groupBy("c").agg(F.count("*").alias("df"))
    each = one.where(F.length("_q") >= 2).select("_q", F.explode(chars("_q")).alias("c")).join(df, "c", "left")
    rare = each.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "c"))).alias("s"))
    open_ = _held(rare.select("_q", F.transform("s", lambda x: x["c"]).alias("c"), F.size("s").alias("m")).where("m >= 2"), "open")

    def pairs(c: Column) -> Column:
        """Any two of some characters, as one string."""
        some = F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.concat(F.least(x, y), F.greatest(x, y))))
        return F.flatten(some)

    twos = _held(names.where(F.size(chars("_a")) >= 2).select("id", "_row", F.substring("_a", 1, 2).alias("head"), F.explode(pairs(chars("_a"))).alias("_k")), "twos")
    step = 0
    while not open_.isEmpty():
        t = F.greatest(F.lit(3), F.col("m") - step)
        keys = open_.where("m >= 3").select("_q", F.explode(pairs(F.slice("c", F.lit(1), F.col("m") - t + 2))).alias("_k"))
        more = _best(keys.join(twos.select("_k", "_row"), "_k").select("_q", "_row").distinct(), names, near_score, 1)
        both = best.unionByName(more).groupBy("_q", "id", "source").agg(F.max(F.struct("score", -F.length("alias"), "alias")).alias("b")).select("_q", "id", "source", F.col("b.alias").alias("alias"), F.col("b.score").alias("score"))
        best = _held(both.withColumn("_r", F.row_number().over(W.partitionBy("_q").orderBy(*order))).where(F.col("_r") <= k).drop("_r"), "near")
        sure = best.groupBy("_q").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        left = open_.join(sure, "_q", "left").where(F.coalesce(F.col("n") < k, F.lit(True)) | (F.col("least") < 20 + t))
        last = left.where((t == 3) | (F.col("m") < 3)).select("_q", "c")
        # Of any two characters the lowest ids, of one beginning and of all, as one with the question's own does not count here.
        low = lowest(lowest(twos.groupBy("_k", "head", "id").agg(F.min("_row").alias("_row")), ["_k", "head"], k), ["_k"], 2 * k)
        ends = _best(last.select("_q", F.explode(pairs(F.col("c"))).alias("_k")).join(low, "_k").select("_q", "_row").distinct(), names, near_score, 1)
        if not last.isEmpty():
            best = _held(best.unionByName(ends).groupBy("_q", "id", "source").agg(F.max(F.struct("score", -F.length("alias"), "alias")).alias("b")).select("_q", "id", "source", F.col("b.alias").alias("alias"), F.col("b.score").alias("score")), "near")
        open_ = _held(left.where((t > 3) & (F.col("m") >= 3)).select("_q", "c", "m"), "open")
        step = max(1, 2 * step)
    # Of the rows that are found, whichever of their aliases fits best.
    every = best.select("_q", "id", "source").join(names.select("_row", "id", "source"), ["id", "source"]).select("_q", "_row")
    found = q.join(_best(every, names, near_score, 1), "_q")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k).select("qid", "id", "source", "alias", "score", "rank")


def conflicts(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``qid, first, second``: the two lowest ids of a tie between pages, of questions without a
    lock; those no whole name fits are judged by the sums over their words."""
    open_ = queries.join(locked(queries, aliases), "qid", "left_anti")
    whole = scores(open_, aliases).select("qid", "id", "source", "score")
    words = by_tokens(open_.join(whole.select("qid").distinct(), "qid", "left_anti"), aliases, LOCK_BAND, several=False)
    top = whole.unionByName(words).withColumn("r", F.rank().over(W.partitionBy("qid").orderBy(F.desc("score")))).where(f"r = 1 and score >= {LOCK_BAND}")
    tie = top.groupBy("qid").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.min("source").alias("a"), F.max("source").alias("b")).where("a <> b and size(ids) > 1")
    return tie.select("qid", F.get("ids", F.lit(0)).alias("first"), F.get("ids", F.lit(1)).alias("second"))


def trigger_match(queries: DataFrame, triggers: DataFrame) -> DataFrame:
    """``qid, rel, score, ambiguous`` by the longest trigger in the question; ``^x`` must be
    the whole question; two pages with equal scores are ambiguous. ``triggers(rel, word)``.

    A question that is asked several times is looked up once. Triggers up to ``FEW_TRIGGERS`` are sent to
    every task; more of them meet the questions' characters in a merge join."""
    t = triggers.select("rel", F.lower("word").alias("word")).distinct()
    q = queries.select("qid", F.lower(F.trim("q")).alias("q"))
    exact = F.col("word").startswith("^")
    bare = F.when(exact, F.expr("substring(word, 2)")).otherwise(F.col("word"))
    points = F.when(exact & (F.col("q") == bare), 1000 + F.length(bare)).when(~exact & F.contains("q", F.col("word")), F.length("word")).otherwise(0)
    inner = F.explode(F.array_distinct(F.concat(_grams(F.col("q"), 1), _grams(F.col("q"), 2))))
    few = t.limit(FEW_TRIGGERS + 1).count() <= FEW_TRIGGERS
    keyed = t.withColumn("_k", F.substring(bare, 1, 2))
    hits = q.select("q").distinct().withColumn("_k", inner).join(F.broadcast(keyed) if few else keyed.hint("merge"), "_k").withColumn("score", points).where("score > 0")

    def best(rows: DataFrame, by: str, low: str, high: str) -> DataFrame:
        each = rows.groupBy(by, "score").agg(F.min(low).alias("low"), F.max(high).alias("high"))
        return each.groupBy(by).agg(F.max_by(F.struct("low", "high"), "score").alias("r"), F.max("score").alias("score")).select(by, "score", "r.low", "r.high")

    top = best(q.join(best(hits, "q", "rel", "rel"), "q"), "qid", "low", "high")
    return top.select("qid", F.col("low").alias("rel"), "score", F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("ambiguous"))


def verified(aliases: DataFrame) -> DataFrame:
    """``id, alias, hit, ok``: whether every alias locks its own row."""
    q = aliases.select(F.concat_ws("\u0000", "id", "alias").alias("qid"), F.col("alias").alias("q"), F.col("id").alias("own"))
    hit = pick(scores(q.select("qid", "q"), aliases)).select("qid", F.col("id").alias("hit"))
    return q.join(hit, "qid", "left").select(F.col("own").alias("id"), F.col("q").alias("alias"), "hit", F.coalesce(F.col("own") == F.col("hit"), F.lit(False)).alias("ok"))


def proven(aliases: DataFrame, pages: DataFrame, today: Column) -> DataFrame:
    """``id, problem, alias, hit`` of an alias table ``(id, alias, source)`` with ``pages(rel, valid_from, invalid_at,
    status)``: rows whose page is missing or not in force, ids of several sources, and names of the live rows
    that lock nothing, another row or another page. Only live rows take part in the lock; ``hit`` is what a name
    has locked, for a row without a page its source. No rows: the table is sound."""
    none = F.lit(None).cast("string")
    rows = aliases.select("id", "source").distinct().join(pages.select(F.col("rel").alias("source"), in_force(F.col("valid_from"), F.col("invalid_at"), today, F.col("status")).alias("_in")), "source", "left")
    gone = rows.where("_in is null or not _in").select("id", F.when(F.col("_in").isNull(), "missing").otherwise("not in force").alias("problem"), none.alias("alias"), F.col("source").alias("hit"))
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("several sources").alias("problem"), none.alias("alias"), none.alias("hit"))
    live = _held(aliases.join(rows.where("_in").select("id", "source"), ["id", "source"], "left_semi").select("id", "alias", "source"), "live")
    asked = live.distinct().select(F.concat_ws("\u0000", "id", "source", "alias").alias("qid"), F.col("alias").alias("q"), F.col("id").alias("own"), F.col("source").alias("page"))
    got = asked.join(pick(scores(asked.select("qid", "q"), live)).select("qid", F.col("id").alias("_id"), F.col("source").alias("_page")), "qid", "left")
    problem = F.when(F.col("_id").isNull(), "locks nothing").when(F.col("_id") != F.col("own"), "locks another row").when(F.col("_page") != F.col("page"), "locks another page")
    names = got.select(F.col("own").alias("id"), problem.alias("problem"), F.col("q").alias("alias"), F.when(problem == "locks another page", F.col("_page")).otherwise(F.col("_id")).alias("hit")).where("problem is not null")
    return gone.unionByName(several).unionByName(names)


def longest_prefix(paths: DataFrame, path: str, zones: DataFrame) -> DataFrame:
    """``paths`` with the longest of ``zones(prefix, target)`` that ends at a separator; null
    if none does. The prefixes of each path are made and looked up by equality."""
    parts = F.split(path, "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.withColumn("_row", F.monotonically_increasing_id())
    found = each.select("_row", F.explode(made).alias("prefix")).join(zones, "prefix").groupBy("_row").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("z"))
    return each.join(found, "_row", "left").select(*paths.columns, F.col("z.prefix").alias("prefix"), F.col("z.target").alias("target"))


def proposals(pages: DataFrame, aliases: DataFrame, nouns: DataFrame, demand: DataFrame, first_id: int, k: int) -> DataFrame:
    """New alias rows: pages not locked yet, by demand; nouns that are free and are claimed by
    one page only; ids follow the last one. ``nouns(rel, word)``, ``demand(rel, n)``."""
    free = nouns.join(aliases.select(F.col("alias").alias("word")), "word", "left_anti")
    once = free.groupBy("word").agg(F.countDistinct("rel").alias("n"), F.min("rel").alias("rel")).where("n = 1").select("rel", "word")
    open_ = pages.select("rel").join(aliases.select(F.col("source").alias("rel")), "rel", "left_anti").join(demand, "rel", "left").fillna(0, ["n"])
    words = once.groupBy("rel").agg(F.sort_array(F.collect_set("word")).alias("words"))
    ranked = open_.join(words, "rel").orderBy(F.desc("n"), "rel").limit(k)
    return ranked.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "rel")) + (first_id - 1))  # at most k rows


def accepted(ticked: DataFrame, aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """``ticked(n, id, alias, source)`` taken in the order of ``n``, with ``reason`` where one is not: its page is not
    among ``pages(rel)``, or its id or alias is taken by ``aliases(id, alias)`` or a row before it that was
    accepted. ``n`` tells rows apart.

    In each round all rows are accepted that are the first of those left both for their id and for their
    alias, and what claims the same goes; the very first is always among them."""
    t = _held(ticked.select("n", "id", "alias", "source"), "ticked")
    there = pages.select(F.col("rel").alias("source")).distinct()
    left = _held(t.join(there, "source", "left_semi").join(aliases.select("id").distinct(), "id", "left_anti").join(aliases.select("alias").distinct(), "alias", "left_anti").select("n", "id", "alias"), "left")
    taken = left.limit(0)
    while not left.isEmpty():
        first = lambda c: left.groupBy(c).agg(F.min("n").alias(f"_{c}"))
        won = _held(left.join(first("id"), "id").join(first("alias"), "alias").where((F.col("n") == F.col("_id")) & (F.col("n") == F.col("_alias"))).select("n", "id", "alias"), "won")
        taken = _held(taken.unionByName(won), "taken")
        left = _held(left.join(won.select("id"), "id", "left_anti").join(won.select("alias"), "alias", "left_anti").select("n", "id", "alias"), "left")
    claims = lambda c: aliases.select(c).distinct().withColumn(f"_{c}", F.lit(-1).cast("long")).unionByName(taken.select(c, F.col("n").cast("long").alias(f"_{c}"))).groupBy(c).agg(F.min(f"_{c}").alias(f"_{c}"))
    told = t.join(there.withColumn("_page", F.lit(True)), "source", "left").join(claims("id"), "id", "left").join(claims("alias"), "alias", "left")
    reason = F.when(F.col("_page").isNull(), "no such page").when(F.col("_id") < F.col("n"), "id is taken").when(F.col("_alias") < F.col("n"), "alias is taken")
    return told.select("n", "id", "alias", "source", reason.alias("reason"))


def apply_ticked(spark, aliases: list[tuple], ticked: list[tuple], pages: set[str]) -> DataFrame:
    """The same of lists, ``aliases`` of ``(id, alias, ...)`` and ``ticked`` of ``(id, alias, source)``: ``id, alias, source,
    reason``."""
    rows = spark.createDataFrame([(n, *x) for n, x in enumerate(ticked)], "n long, id string, alias string, source string")
    have = spark.createDataFrame([a[:2] for a in aliases], "id string, alias string")
    return accepted(rows, have, spark.createDataFrame([(p,) for p in pages], "rel string")).orderBy("n").drop("n")
