"""Upkeep of pages: locks and triggers that no longer hold, health pages, catalogues and cards,
views for a learner and for a session's start, references, and pages made from other memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import redact, text as T
from recollect.operators.index import DEAD

# Marks of a health page, headings of a digest, and what a digest says of an empty day.
SEALED, PENDING = "- 最近已封：", "- 待总结"
DIGEST_HEADS = ("## 定下来的事", "## Decisions")
NOTHING_DECIDED = "没有定下来的事"
NO_ANSWER = ("skipped", "failed")


# ---------------------------------------------------------------- what no longer holds
def stale_locks(aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, source, problem`` of ``aliases(id, source)`` whose page is missing or, by
    ``pages(rel, tier, status)``, dead; the problem is ``missing`` or the page's status."""
    p = pages.select(F.col("rel").alias("source"), "tier", "status")
    j = aliases.select("id", "source").distinct().join(p, "source", "left")
    problem = F.when(F.col("tier").isNull(), "missing").when(F.col("tier") == "dead", F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("dead")))
    return j.select("id", "source", problem.alias("problem")).where("problem is not null")


def stale_triggers(triggers: DataFrame, pages: DataFrame) -> DataFrame:
    """``rel`` of triggers whose page is missing or dead."""
    return triggers.select("rel").distinct().join(pages.where("tier <> 'dead'").select("rel"), "rel", "left_anti")


def trigger_coverage(catalogue: DataFrame) -> DataFrame:
    """One row of ``catalogue(file, triggers)``: how many, how many have triggers, which have none."""
    none = F.coalesce(F.size("triggers"), F.lit(0)) <= 0
    return catalogue.agg(
        F.count("*").alias("n"), F.sum((~none).cast("int")).cast("long").alias("with_triggers"), F.sort_array(F.collect_list(F.when(none, F.col("file")))).alias("missing")
    ).withColumn("ok", F.size("missing") == 0)  # a maintained list


def promoted(wanted: DataFrame, ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """``file, active, reason`` for ``wanted(file)``: only a page whose last decision in
    ``ledger(file, seq, kind, decision)`` is to adopt it, and that is there and neither dead nor
    replaced by ``pages(file, status)``, becomes active."""
    said = F.when(F.col("kind") == "promote", "promoted").when(F.col("kind") == "record", F.col("decision"))
    last = ledger.where("kind in ('promote', 'record')").groupBy("file").agg(F.max_by(said, "seq").alias("last"))
    name = F.element_at(F.split("file", "/"), -1)
    rows = wanted.select(F.when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit(".md"))).alias("file"))
    status = F.lower(F.coalesce("status", F.lit("")))
    reason = (
        F.when(~F.col("last").eqNullSafe(F.lit("adopt")), "need-adopt-first")
        .when(F.col("there").isNull(), "missing-page")
        .when(status == "active", "already-active")
        .when(status.isin(*DEAD) | status.startswith("superseded"), "not-provisional")
        .otherwise("promoted")
    )
    out = rows.join(last, "file", "left").join(pages.select("file", "status", F.lit(True).alias("there")), "file", "left").withColumn("reason", reason)
    return out.select("file", F.col("reason").isin("promoted", "already-active").alias("active"), "reason")


# ---------------------------------------------------------------- health and catalogues
def seals(pages: DataFrame) -> DataFrame:
    """``rel, sealed, through, pending`` from the marked lines of health pages ``(rel, body)``, the
    last line of a kind counting."""
    lines = F.split("body", "\n")
    last = lambda mark: F.element_at(F.filter(lines, lambda x: x.startswith(mark)), -1)
    tick = lambda x: F.get(F.split(x, "`"), F.lit(1))
    some = lambda mark: F.when(F.size(F.filter(lines, lambda x: x.startswith(mark))) > 0, last(mark))
    sealed, waiting = some(SEALED), some(PENDING)
    return pages.select("rel", F.when(sealed.isNull(), "missing").otherwise(F.coalesce(tick(sealed), F.lit("none"))).alias("sealed"), F.nullif(F.regexp_extract(waiting, "\\d{4}-\\d{2}-\\d{2}", 0), F.lit("")).alias("through"), tick(waiting).alias("pending"))


def lamps(pages: DataFrame, now: str, days: int = 3, needs: tuple[str, ...] = ("key", "writer")) -> DataFrame:
    """``rel, lamp, writable, nightly, stale, act`` from the heads of health pages ``(rel, meta)``: writable
    if all that is needed is said to be present; a run that is said to go on and began ``days`` ago is
    stale; ``act`` says that a person is needed."""
    meta = lambda k: F.col("meta")[k]
    lamp, writable = F.coalesce(meta("lamp"), F.lit("unset")), F.lit(True)
    for name in needs:
        writable &= meta(name).eqNullSafe(F.lit("present"))
    old = F.coalesce(F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(meta("nightly_at")))) / 86400) >= days, F.lit(False))
    nightly = F.coalesce(meta("nightly"), F.lit(""))
    stale = (nightly != "") & (lamp == "running") & old
    return pages.select("rel", lamp.alias("lamp"), writable.alias("writable"), nightly.alias("nightly"), stale.alias("stale"), (~writable | nightly.isin(*NO_ANSWER) | stale).alias("act"))


def to_ask(catalogue: DataFrame, asked: DataFrame) -> DataFrame:
    """Provisional pages ``catalogue(file, status, triggers)`` that have triggers and were not asked about
    in ``asked(file, repeated)``: those whose last ask is still fresh are left out."""
    fresh = asked.where("repeated").select("file")
    return catalogue.where((F.lower("status") == "provisional") & (F.size("triggers") > 0)).join(fresh, "file", "left_anti")


def card_targets(pages: DataFrame, volatile: list[str]) -> DataFrame:
    """Pages ``(rel, tier, meta)`` that cards may be made of: rules and topics that are neither secret nor
    below a folder whose pages change all the time."""
    moves = F.lit(False)
    for prefix in volatile:
        moves |= F.col("rel").startswith(prefix)
    return pages.where(F.col("tier").isin("rule", "topic") & ~moves & ~redact.is_secret_page(F.col("rel"), F.col("meta")["title"], F.col("meta")["secret"]))


def learner_view(pages: DataFrame, limit: int = 4000) -> DataFrame:
    """``rel, view`` of ``pages(rel, meta, body)``: redacted, white space in one piece; null for secret pages."""
    secret = redact.is_secret_page(F.col("rel"), F.col("meta")["title"], F.col("meta")["secret"])
    flat = F.trim(F.regexp_replace(redact.redact(F.col("body")), "\\s+", " "))
    return pages.select("rel", F.when(~secret, F.substring(flat, 1, limit)).alias("view"))


def standing_page(rows: DataFrame) -> DataFrame:
    """``page, sha, n`` of a standing index ``(id, names, source, how)``: a line for each row in order of
    ids, and the digest of the alias table it was made from."""
    order = F.struct("id", "names", "source", "how")
    lines = F.transform(F.sort_array(F.collect_list(order)), lambda r: F.concat_ws(" | ", r["id"], r["names"], r["source"], r["how"]))  # a maintained list
    return rows.agg(F.array_join(lines, "\n").alias("page"), F.count("*").alias("n")).withColumn("sha", F.substring(F.sha1(F.col("page").cast("binary")), 1, 16))


# ---------------------------------------------------------------- sessions
def digest_lines(pages: DataFrame) -> DataFrame:
    """``rel, seq, line``: the list items under a page's decisions heading, without those that say that
    there are none; ``pages(rel, body)``."""
    head = "|".join(DIGEST_HEADS)
    block = F.regexp_extract("body", f"(?s)(?:{head})(.*?)(?:\\n## |\\z)", 1)
    items = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[-*]") & ~F.contains(x, F.lit(NOTHING_DECIDED)))
    return pages.select("rel", F.posexplode(items).alias("seq", "line"))


def session_start(lines: DataFrame, limit: int = 1600) -> DataFrame:
    """``root, zh, context``: what a session is told, of ``lines(root, n, line, confirmed, state)`` in order;
    in Chinese if any line is. Lines that may have changed are marked, unconfirmed ones too; whole
    lines up to a number of characters."""
    zh = F.max(F.col("line").rlike("[\\u3400-\\u9fff]")).over(W.partitionBy("root"))
    mark = F.when(F.col("state") == "unsure", F.when(F.col("zh"), "（可能已改，先核对）").otherwise(" (may have changed; check)")).otherwise("")
    open_ = F.when(~F.col("confirmed"), F.when(F.col("zh"), "（未确认）").otherwise(" (unconfirmed)")).otherwise("")
    each = lines.withColumn("zh", zh).withColumn("text", F.concat(F.lit("- "), "line", open_, mark))
    running = F.sum(F.length("text") + 1).over(W.partitionBy("root").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    kept = each.withColumn("_sum", running).where(F.col("_sum") <= limit)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")  # within the limit
    return kept.groupBy("root").agg(F.max("zh").alias("zh"), joined.alias("context"))


def memory_pages(sessions: DataFrame, observations: DataFrame, facts: int = 6, files: int = 3) -> DataFrame:
    """``session, title, how, facts, files, n`` from another memory's ``sessions(session, request)`` and
    ``observations(session, seq, title, decision, fact, file)``: the request or else the first title names
    the page, the first decision is its rule, and the first facts and files stand on it."""
    first = lambda c, k: F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("seq"), F.col(c).alias("v"))))), lambda x: x["v"])), 1, k)  # noqa: E731  of one session
    o = observations.groupBy("session").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("_t"), F.min_by("decision", F.when(F.col("decision").isNotNull(), F.col("seq"))).alias("how"), first("fact", facts).alias("facts"), first("file", files).alias("files"), F.count("*").alias("n"))
    name = F.coalesce(F.when(F.trim("request") != "", F.trim("request")), F.col("_t"), F.col("session"))
    return sessions.join(o, "session").select("session", name.alias("title"), "how", "facts", "files", "n")


def reused_digests(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``pages(key, n, ...)`` with ``digest``: the one of ``known(key, n, digest)`` if nothing was added since."""
    return pages.join(known.select("key", F.col("n").alias("_n"), F.col("digest").alias("_d")), "key", "left").withColumn("digest", F.when(F.col("n") == F.col("_n"), F.col("_d"))).drop("_n", "_d")


# ---------------------------------------------------------------- references
def resolved(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """``ref, rel``: the page that a reference in brackets or quotes names, as it is or with its ending;
    null if there is none."""
    bare = F.btrim(F.regexp_extract(F.regexp_replace("ref", "^\\s*[\"']|[\"']\\s*$", ""), "^\\s*(?:\\[\\[)?([^\\]|#]*)", 1))
    want = refs.select("ref").distinct().withColumn("_b", bare)
    have = pages.select(F.col("rel").alias("_rel"))
    a = want.join(have, F.col("_b") == F.col("_rel"), "left").withColumnRenamed("_rel", "_one")
    return a.join(have, F.concat("_b", F.lit(".md")) == F.col("_rel"), "left").select("ref", F.coalesce("_one", "_rel").alias("rel"))


def repaired_links(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``rel, body, n_lost`` of ``pages(rel, body)``: links whose target is no page, neither as it is nor with
    its ending, become code."""
    links = pages.select("rel", F.explode(F.array_distinct(T.extract_all(F.col("body"), "\\[\\[[^\\]\\n]+\\]\\]"))).alias("link")).withColumn("_t", F.trim(F.regexp_extract("link", "\\[\\[([^\\]#|]*)", 1)))
    have = known.select(F.col("rel").alias("_t")).union(known.where("rel like '%.md'").select(F.regexp_replace("rel", "\\.md$", ""))).distinct()
    lost = links.join(have, "_t", "left_anti").groupBy("rel").agg(F.sort_array(F.collect_set("link")).alias("lost"))
    code = lambda x: F.concat(F.lit("`"), F.regexp_extract(x, "\\[\\[([^\\]]*)\\]\\]", 1), F.lit("`"))
    body = F.aggregate(F.coalesce("lost", F.array().cast("array<string>")), F.col("body"), lambda s, x: F.replace(s, x, code(x)))
    return pages.join(lost, "rel", "left").select("rel", body.alias("body"), F.coalesce(F.size("lost"), F.lit(0)).alias("n_lost"))


def replaced_page(pages: DataFrame) -> DataFrame:
    """``rel, old``: the page ``X (old)`` or ``X（旧）`` beside the page ``X``."""
    have = pages.select(F.col("rel").alias("old"))
    stem = F.regexp_replace("rel", "\\.md$", "")
    want = pages.select("rel", F.explode(F.array(F.concat(stem, F.lit(" (old).md")), F.concat(stem, F.lit("（旧）.md")))).alias("old"))
    return want.join(have, "old").groupBy("rel").agg(F.min("old").alias("old"))


def source_pages(files: DataFrame, folders: list[str]) -> DataFrame:
    """``answer, rel, place``: pages named by an answer's observation files ``(answer, seq, file)``, each path
    from one of the top folders on, in order of first sight."""
    rel = F.regexp_extract("file", "(?:^|/)((?:" + "|".join(folders) + ")/.*)$", 1)
    seen = files.select("answer", "seq", rel.alias("rel")).where("rel <> ''").groupBy("answer", "rel").agg(F.min("seq").alias("seq"))
    return seen.select("answer", "rel", F.row_number().over(W.partitionBy("answer").orderBy("seq", "rel")).alias("place"))


def view_texts(pages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``rel, text`` that neighbours are found by: title and body, with ``aliases(source, alias)`` of live rows
    before them if given (pages without one are left out then)."""
    text = F.concat_ws("\n", "title", "body")
    if aliases is None:
        return pages.select("rel", text.alias("text"))
    names = aliases.groupBy(F.col("source").alias("rel")).agg(F.array_join(F.sort_array(F.collect_set("alias")), " ").alias("names"))
    return pages.join(names, "rel").select("rel", F.concat_ws("\n", "names", text).alias("text"))


def in_order_digest(rows: DataFrame, order: list, text: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``sha``: one digest over the texts of a bounded set in order, each with its length before it; ``by``
    some columns, one for each set."""
    part = F.concat(F.length(text).cast("string"), F.lit(":"), text)
    every = F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], part.alias("_t")))), lambda x: x["_t"])
    return (rows.groupBy(*by) if by else rows).agg(F.sha2(F.array_join(every, "\n").cast("binary"), 256).alias("sha"))


def vector_key(texts: DataFrame, model: str) -> DataFrame:
    """``sha``: under which vectors of a model over ``texts(rel, text)`` are kept, as they change with either."""
    return in_order_digest(texts.withColumn("_m", F.lit(model)), ["_m", "rel"], F.concat_ws("\u0000", F.lit(model), "rel", "text"))


def capture_sample(sessions: DataFrame, quota: dict[str, int], seed: int, low: int = 8, high: int = 60, answered: float = 0.7) -> DataFrame:
    """Sessions ``(session, stratum, n_turns, n_answered)`` fit for judging, up to a quota of each stratum, with
    their ``place`` in the order of a seeded hash."""
    fit = sessions.where(F.col("n_turns").between(low, high) & (F.col("n_answered") >= answered * F.col("n_turns")))
    place = F.row_number().over(W.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("session").cast("string"))), "session"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("stratum"))
    return fit.withColumn("place", place).where(F.col("place") <= F.coalesce(most, F.lit(0)))


def parsed_labels(replies: DataFrame, ids: DataFrame, labels: list[str]) -> DataFrame:
    """``id, label`` from replies of lines ``id: label``; ids nobody asked about and unknown labels are dropped."""
    line = replies.select(F.explode(F.split("reply", "\n")).alias("line"))
    pair = line.select(F.trim(F.regexp_extract("line", "^\\s*([^:：]+)[:：]", 1)).alias("id"), F.lower(F.trim(F.regexp_extract("line", "[:：]\\s*(.*)$", 1))).alias("label"))
    return pair.where(F.col("label").isin(*labels)).join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi").dropDuplicates(["id", "label"])
