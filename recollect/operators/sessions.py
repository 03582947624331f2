"""Conversation logs to turns, days and decisions; budgets, de-duplication, streaks, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.operators.orders import running
from recollect.plans.place import place


def turns(messages: DataFrame, session: str, order: str, is_ask: Column, is_answer: Column, text: str) -> DataFrame:
    """``session, turn_no, ask, answer``: each ask opens a turn, whose answer is the last
    non-empty answer before the next ask. What stands before the first ask belongs to none."""
    w = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    n = messages.withColumn("turn_no", F.sum(is_ask.cast("int")).over(w)).where("turn_no > 0")
    said = is_answer & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    return n.groupBy(session, "turn_no").agg(F.max(F.when(is_ask, F.col(text))).alias("ask"), F.max_by(F.when(said, F.col(text)), F.when(said, F.col(order))).alias("answer"))


def without_noise(messages: DataFrame, session: str, noise: Column, automated: Column) -> DataFrame:
    """Messages that are noise go; of sessions with an automated one, all go."""
    machine = messages.where(automated).select(session).distinct()
    return messages.join(machine, session, "left_anti").where(~noise)


def by_day(rows: DataFrame, keys: list[str], day: Column, *aggregates: Column) -> DataFrame:
    return rows.groupBy(*keys, day.alias("day")).agg(*aggregates)


def running_budget(rows: DataFrame, key: str, order: list, size: Column, budget: int, keep_crossing: bool) -> DataFrame:
    """The first rows of each key within a budget. ``keep_crossing``: a row is kept while the
    sum before it is within the budget; else while the sum with it is. Nothing is taken after
    the first row left out."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(size).over(w)
    return rows.withColumn("running", total).where((F.col("running") - size <= budget) if keep_crossing else (F.col("running") <= budget))


def segments(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """``key, segment, n``: turns packed greedily, in order, to segments of a character budget: a turn begins
    one if there is something before it that it does not fit behind. A null text has no characters.

    From sums over all turns every turn knows where the next segment would begin if one began with it. From
    the first turns on these pointers are followed, first one, then two, four, eight at once, so that a
    session of a million turns takes some twenty rounds and no task holds it."""
    items = rows.select(key, F.col(order).alias("_o"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_n"))
    line = _kept(running(items, [F.asc(key), F.asc("_o"), F.asc("_n")], {"_upto": F.col("_n")}).withColumnRenamed("at", "_at"), "line")
    ends = line.groupBy(key).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    # How many turns end at or below a sum: in one order with the sums that are asked for, behind equal ones.
    before = F.col("_upto") - F.col("_n")
    marks = line.select(F.col("_upto").alias("_v"), F.lit(0).alias("_asks"), "_at").unionByName(line.select(before.alias("_v"), F.lit(1).alias("_asks"), "_at")).unionByName(line.select((before + budget).alias("_v"), F.lit(2).alias("_asks"), "_at"))
    told = running(marks, [F.asc("_v"), F.asc("_asks"), F.asc("_at")], {"_below": (F.col("_asks") == 0).cast("long")}).where("_asks > 0")
    count = lambda k: F.max(F.when(F.col("_asks") == k, F.col("_below")))
    fits = told.groupBy("_at").agg(count(1).alias("_empty"), count(2).alias("_full"))
    # A turn that is too long by itself still ends its segment.
    follows = F.col("_full") + F.when(F.col("_full") == F.col("_empty"), 2).otherwise(1)
    nodes = _kept(line.select(key, "_at").join(fits.select("_at", follows.alias("_next")), "_at").join(ends, key).withColumn("_next", F.least("_next", F.col("_last") + 1)), "nodes")
    jump = nodes.where(F.col("_next") <= F.col("_last")).select("_at", "_next")
    reached = ends.select(key, F.col("_first").alias("_at"))
    while True:
        more = _kept(reached.join(jump, "_at").select(key, F.col("_next").alias("_at")), "reached")
        if more.isEmpty():
            break
        reached = _kept(reached.unionByName(more), "reached")
        far = jump.select(F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        jump = _kept(jump.join(far, "_next").select("_at", F.col("_far").alias("_next")), "jump")
    starts = running(reached, [F.asc(key), F.asc("_at")])
    lowest = starts.groupBy(key).agg(F.min("at").alias("_low"))
    out = starts.join(lowest, key).join(nodes.select("_at", "_next"), "_at")
    return out.select(key, (F.col("at") - F.col("_low")).cast("int").alias("segment"), (F.col("_next") - F.col("_at")).alias("n"))


def first_seen(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def newest(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The ``k`` newest rows of each key, numbered."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("n") <= k)


# Observations that count as decisions.
DECISIONS = ["decision", "change", "feature", "bugfix", "refactor"]


def decisions(observations: DataFrame, k: int = 120) -> DataFrame:
    """``project, root, tag, n, session, type, title, at`` of ``observations(session, seq, project, root, type, title, at)``: of
    each project and root the newest decisions with a title. What has no time comes last; equal times are
    in the order of session and ``seq``. Projects of one name in two folders are two, told apart by
    ``tag``, the beginning of the root's digest (empty without a root); a project without a name is ``?``."""
    named = observations.where(F.col("type").isin(*DECISIONS) & (F.coalesce("title", F.lit("")) != ""))
    named = named.withColumn("project", F.when(F.coalesce("project", F.lit("")) == "", "?").otherwise(F.col("project"))).withColumn("root", F.coalesce("root", F.lit("")))
    order = W.partitionBy("project", "root").orderBy(F.desc_nulls_last("at"), "session", "seq")
    tag = F.when(F.col("root") == "", "").otherwise(F.substring(F.sha1("root"), 1, 6))
    return named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("project", "root", tag.alias("tag"), "n", "session", "type", "title", "at")


def to_distill(turns: DataFrame, session: str, ts: str, most: int = 40, least: int = 2) -> DataFrame:
    """``session, n, last``: the sessions with ``least`` turns or more whose last turn is newest, ``most`` of them;
    equal times by session."""
    each = turns.groupBy(session).agg(F.count("*").alias("n"), F.max(ts).alias("last")).where(F.col("n") >= least)
    return each.orderBy(F.desc_nulls_last("last"), session).limit(most)


def roll_up(observations: DataFrame, session: str, order: str, first: list[str], last: list[str]) -> DataFrame:
    """Per session the first value of some columns, the last of others, and the count."""
    return observations.groupBy(session).agg(*[F.min_by(c, order).alias(f"first_{c}") for c in first], *[F.max_by(c, order).alias(f"last_{c}") for c in last], F.count("*").alias("n"))


def days_classified(days: DataFrame, day: str, sealed: Column, stub: Column, empty: Column) -> DataFrame:
    """``day, state``: sealed beats empty beats stub."""
    rank = F.when(sealed, 1).when(empty, 2).when(stub, 3).otherwise(4)
    return days.groupBy(day).agg(F.element_at(F.array(F.lit("sealed"), F.lit("empty"), F.lit("stub"), F.lit("other")), F.min(rank)).alias("state"))


def calendar(first: str, last: str, df: DataFrame, day: str) -> DataFrame:
    """Every day from first to last, with those of ``df`` or null."""
    span = df.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as {day}")
    return span.join(df, day, "left")


def streaks(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """``keys, first_day, last_day, n_days`` of the runs of consecutive days."""
    d = days.select(*keys, F.col(day).alias("_d")).distinct()
    w = W.partitionBy(*keys).orderBy("_d") if keys else W.orderBy("_d")
    runs = d.withColumn("_g", F.date_sub("_d", F.row_number().over(w)))
    return runs.groupBy(*keys, "_g").agg(F.min("_d").alias("first_day"), F.max("_d").alias("last_day"), F.count("*").alias("n_days")).drop("_g")


def last_state(events: DataFrame, key: str, order: list, kind: str) -> DataFrame:
    """The last kind of each key by order."""
    return events.groupBy(key).agg(F.max_by(kind, F.struct(*order)).alias("state"))


def suppressed(events: DataFrame, key: str, ts: str, order: str, is_ask: Column, clears: Column, hours: int = 24) -> DataFrame:
    """Each ask with ``repeated``: whether there was one within the hours before it and no
    clearing event since."""
    w = W.partitionBy(key).orderBy(ts, order).rowsBetween(W.unboundedPreceding, -1)
    ask = F.last(F.when(is_ask, F.col(ts)), ignorenulls=True).over(w)
    clear = F.last(F.when(clears, F.struct(ts, order)), ignorenulls=True).over(w)
    asked = F.last(F.when(is_ask, F.struct(ts, order)), ignorenulls=True).over(w)
    recent = ask.isNotNull() & (F.col(ts) - F.expr(f"interval {hours} hours") <= ask) & (clear.isNull() | (clear < asked))
    return events.withColumn("repeated", recent).where(is_ask)


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """``left`` with the value of the last row of ``right`` of its key at or before its time:
    one sort of both together, no join."""
    a = left.select(key, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*left.columns).alias("_row"))
    b = right.select(key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn(value, F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(w))
    return out.where("_side = 1").select("_row.*", value)


def replaced_by_day(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, state`` when a session's pages are written anew: by session and day, the page of another
    name goes (``deleted``), and the new one is ``written`` or ``replaced``. Both are ``(session, day, path)``."""
    a, b = old.select("session", "day", F.col("path").alias("_old")), new.select("session", "day", F.col("path"))
    j = b.join(a, ["session", "day"], "left")
    put = j.groupBy("path").agg(F.max(F.col("_old").isNotNull()).alias("_had")).select("path", F.when(F.col("_had"), "replaced").otherwise("written").alias("state"))
    gone = j.where("_old <> path").select(F.col("_old").alias("path")).distinct().join(b.select("path"), "path", "left_anti")
    return put.unionByName(gone.withColumn("state", F.lit("deleted")))


def located(lines: DataFrame, turns_: DataFrame, tokens: Column, said: Column) -> DataFrame:
    """``session, line_id, turn_no`` of the turn a line rests on: the first one at its time if it has one of
    a turn, else the one with most of its words, the first among equals. ``lines(session, line_id, hhmm)``
    with token array ``tokens``; ``turns_(session, turn_no, hhmm)`` with ``said``."""
    a = lines.select("session", "line_id", F.col("hhmm").alias("_at"), F.array_distinct(tokens).alias("_w"))
    b = turns_.select("session", "turn_no", "hhmm", F.array_distinct(said).alias("_s"))
    n = F.size(F.array_intersect("_w", "_s"))
    both = a.join(b, "session").withColumn("_fit", (F.col("_at") == F.col("hhmm")) & (F.col("_at") != "")).withColumn("_n", F.when(F.col("_fit"), 1 << 30).otherwise(n))
    return both.groupBy("session", "line_id").agg(F.max_by("turn_no", F.struct(F.coalesce("_n", F.lit(0)), -F.col("turn_no"))).alias("turn_no"))


def project_roots(rows: DataFrame, cwd: str, tops: DataFrame) -> DataFrame:
    """``rows`` with ``root``: the longest of ``tops(prefix)``, folders known to be a repository's, that holds
    the working folder, else the folder itself; without one, empty."""
    from recollect.operators.lock import longest_prefix

    flat = F.regexp_replace(F.replace(F.coalesce(F.col(cwd), F.lit("")), F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")
    found = longest_prefix(rows.withColumn("_cwd", flat), "_cwd", tops.select("prefix", F.lit(True).alias("target")))
    return found.withColumn("root", F.coalesce("prefix", "_cwd")).drop("_cwd", "prefix", "target")


def asks_once(asks: DataFrame, back: int = 50) -> DataFrame:
    """``asks(ts, id, day, text)`` without repeats: a text counts once a day, and an id once within the last
    ``back`` asks of its day."""
    flat = F.trim(F.regexp_replace(F.lower("text"), "\\s+", " "))
    first = first_seen(asks.withColumn("_f", flat), ["_f", "day"], ["ts", "id"]).drop("_f")
    w = W.partitionBy("day").orderBy("ts", "id")
    numbered = first.withColumn("_n", F.row_number().over(w))
    before = F.lag("_n").over(W.partitionBy("day", "id").orderBy("_n"))
    return numbered.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_n") - F.col("_b") > back)).drop("_n", "_b")


def current_run(days: DataFrame, keys: list[str], day: str, through: str) -> DataFrame:
    """``keys, n_days``: the length of the run that ends on ``through``, 0 without one."""
    runs = streaks(days, keys, day).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("last_day") == F.lit(through).cast("date"), F.col("n_days"))), F.lit(0)).alias("n_days"))
    return runs


def slug_paths(slugs: DataFrame, folders: DataFrame, mark: str = "-") -> DataFrame:
    """``slug, path``: the folder that a name was made from by putting ``mark`` for each slash, among
    ``folders(path)``. A name may hold the mark itself, so there may be several: the one whose first name is the
    longest counts, then whose second is, and so on; empty if there is none.

    Places reached so far meet the folders below them by an equality join, a level of folders a round."""
    parts = F.filter(F.split("slug", mark), lambda x: x != "")
    below = folders.where("path <> '/'").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("at"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")).distinct()
    below = _kept(below, "folders")
    asked = slugs.select("slug").where("slug is not null").distinct().select("slug", parts.alias("parts"))
    front = _kept(asked.select("slug", "parts", F.lit("").alias("at"), F.array().cast("array<int>").alias("sizes")), "front")
    done = None
    while True:
        i = F.aggregate("sizes", F.lit(0), lambda s, x: s + x)
        here = front.withColumn("i", i)
        ended = here.where(F.col("i") == F.size("parts")).select("slug", "sizes", F.when(F.col("at") == "", "/").otherwise(F.col("at")).alias("path"))
        done = ended if done is None else done.unionByName(ended)
        names = here.where(F.col("i") < F.size("parts")).select("slug", "parts", "at", "sizes", "i", F.explode(F.sequence(F.lit(1), F.size("parts") - F.col("i"))).alias("n"))
        names = names.withColumn("name", F.array_join(F.slice("parts", F.col("i") + 1, F.col("n")), mark))
        front = _kept(names.join(below, ["at", "name"]).select("slug", "parts", F.concat("at", F.lit("/"), "name").alias("at"), F.concat("sizes", F.array("n")).alias("sizes")), "front")
        if front.isEmpty():
            best = done.groupBy("slug").agg(F.max_by("path", "sizes").alias("path"))
            return asked.select("slug").join(best, "slug", "left").select("slug", F.coalesce("path", F.lit("")).alias("path"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read back, so that rounds do not carry the plans of earlier ones."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
