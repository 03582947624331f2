"""Queries over the forms of texts, heads of pages, digests, sessions, grades and upkeep."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import digest as D
from recollect.functions import frontmatter as FM
from recollect.functions import redact as X
from recollect.functions import text as T
from recollect.operators import evaluate as E
from recollect.operators import index as I
from recollect.operators import quality as Q
from recollect.operators import rank as R
from recollect.operators import sessions as S
from recollect.operators import upkeep as U
from recollect.operators import vectors as V
from recollect.plans.memory import REDACTED
from recollect.plans.registry import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _items(spark, sf):
    return table(spark, sf, "benchmark")


# ------------------------------------------------------------------ forms of texts
_FUNCTION = "list_value(" + ", ".join(f"'{w}'" for w in T.ENGLISH_FUNCTION) + ")"


@query("select doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2))::int as n_tokens, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2))::int as n_bench, len(regexp_extract_all(lower(text), '[a-z0-9一-鿿]+'))::int as n_runs from documents")
def token_forms(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.size(T.tokens(t)).alias("n_tokens"), F.size(T.bench_tokens(t)).alias("n_bench"), F.size(T.run_tokens(t)).alias("n_runs"))


@query(f"with w as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2)) as w from benchmark), k as (select item_id, w, list_filter(w, lambda x: not list_contains({_FUNCTION}, x)) as k from w) select item_id, unnest(case when len(k) > 0 then k else w end) as term from k")
def query_terms(spark, sf):
    return _items(spark, sf).select("item_id", F.explode(T.query_terms(F.col("text"))).alias("term"))


@query("select item_id, lower(regexp_replace(text, '[^\\pL\\pN\\pM]+', '', 'g')) as form, regexp_replace(regexp_replace(text, '\\|', '/', 'g'), '\\s+', ' ', 'g').trim() as safe, case when length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 60 then rtrim(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 60)) || ' …' else trim(regexp_replace(text, '\\s+', ' ', 'g')) end as short, trim(regexp_replace(text, '[\\\\/:*?\"<>|#^\\[\\]\\r\\n\\t]+', ' ', 'g')) as file from benchmark")
def squashed_forms(spark, sf):
    t = F.col("text")
    return _items(spark, sf).select("item_id", T.compact(t).alias("form"), T.pipe_safe(t).alias("safe"), T.squash(t, 60).alias("short"), T.file_safe(t).alias("file"))


@query("with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark), f as (select w, list_value(w, w || 's', w || 'es', case when w like '%ies' then left(w, length(w) - 3) || 'y' end, case when w like '%es' then left(w, length(w) - 2) end, case when w like '%s' then left(w, length(w) - 1) end) as f from w) select distinct w, unnest(list_filter(f, lambda x: x is not null)) as form from f")
def word_forms(spark, sf):
    words = _items(spark, sf).select(F.explode(T.extract_all(F.lower("text"), "[a-z0-9]+")).alias("w")).distinct()
    return words.select("w", F.explode(T.latin_forms(F.col("w"))).alias("form"))


@query("with w as (select distinct unnest(string_split(text, ' ')) as w from benchmark union select distinct props from events) select w, (regexp_full_match(trim(w), '[A-Za-z0-9._+-]+') and not regexp_full_match(trim(w), '[0-9]+')) as one from w")
def single_concepts(spark, sf):
    w = _items(spark, sf).select(F.explode(F.split("text", " ")).alias("w")).union(table(spark, sf, "events").select("props")).distinct()
    return w.select("w", T.single_concept(F.col("w")).alias("one"))


_LINES = "l as (select doc_id, trim(x) as x, i from (select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as x, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as i from documents))"


@query(
    f"""with {_LINES}, c as (select doc_id, i, contains(x, '**') as b, trim(regexp_replace(regexp_replace(x, '^(?:>\\s*(?:\\[![^\\]]+\\]\\s*)?|[-*+]\\s+|\\d+\\.\\s+)', ''), '[*`_]|\\[\\[([^|\\]]*\\|)?|\\]\\]', '', 'g')) as c from l where x <> '' and not regexp_matches(x, '^(?:#|\\||```|<|!\\[|%%)')),
f as (select * from c where length(c) >= 8 and not regexp_matches(c, '^(?i)status\\s*[:：]')), p as (select doc_id, coalesce(arg_min(c, i) filter (where b), arg_min(c, i)) as c from f group by doc_id)
select doc_id, case when length(c) > 80 then left(c, 79) || '…' else c end as how from documents left join p using (doc_id)"""
)
def rule_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", T.first_rule_line(F.col("text")).alias("how"))


@query("select event_id, regexp_extract('answer: ' || props || ' end', '(?s)\\{.*\\}') as found from events")
def json_found(spark, sf):
    return table(spark, sf, "events").select("event_id", T.json_in_prose(F.concat(F.lit("answer: "), "props", F.lit(" end"))).alias("found"))


@query("select doc_id, term, regexp_matches(lower(text), '(^|[^a-z0-9])' || term || '(s|es)?($|[^a-z0-9])') as has from documents, (select unnest(list_value('license', 'right', 'token', 'test')) as term)")
def has_terms(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "text", F.explode(F.array(*[F.lit(t) for t in ("license", "right", "token", "test")])).alias("term"))
    return rows.select("doc_id", "term", T.has_term(F.col("term"), F.col("text")).alias("has"))


@query("with w as (select item_id, list_distinct(list_transform(regexp_split_to_array(text, '[\\s\\p{P}\\p{S}]+'), lambda x: lower(x))) as w from benchmark) select item_id, unnest(list_filter(w, lambda x: length(x) >= 2 and length(x) <= (case when regexp_full_match(x, '[\\x00-\\x7f]+') then 24 else 12 end) and not regexp_full_match(x, '[0-9]+') and not regexp_matches(x, '^[0-9]{4}-?[0-9]{2}') and x not in ('the', 'and'))) as word from w")
def noun_candidates(spark, sf):
    return _items(spark, sf).select("item_id", F.explode(T.noun_candidates(F.col("text"), ["the", "and"])).alias("word"))


# ------------------------------------------------------------------ heads and digests
_PAGE = """p as (select d.doc_id, d.source || '/' || d.doc_id || '.md' as rel, '---' || chr(10) || 'title: "' || d.lang || ': ' || d.source || '"' || chr(10) || 'status: ' || case when quality = 0 then 'superseded' else 'current' end || chr(10) || 'tags:' || chr(10) || '  - x: y' || chr(10) || '---' || chr(10) as head, d.text from documents d left join labels using (doc_id))"""


def _pages(spark, sf):
    head = F.concat(F.lit('---\ntitle: "'), "lang", F.lit(": "), "source", F.lit('"\nstatus: '), F.when(F.col("quality") == 0, "superseded").otherwise("current"), F.lit("\ntags:\n  - x: y\n---\n"))
    docs = _docs(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("rel"), F.concat(head, "text").alias("content"))


@query(f"with {_PAGE} select doc_id, regexp_extract(head, 'title: \"(.*)\"', 1) as title, regexp_extract(head, 'status: (.*)', 1) as status, 3 as n_keys, sha1(replace(text, chr(13) || chr(10), chr(10))) as body from p")
def page_heads(spark, sf):
    m = _pages(spark, sf).select("doc_id", FM.split_meta(F.col("content")).alias("p"))
    return m.select("doc_id", F.col("p.meta")["title"].alias("title"), F.col("p.meta")["status"].alias("status"), F.size("p.meta").alias("n_keys"), F.sha1(F.col("p.body").cast("binary")).alias("body"))


@query(f"with {_PAGE} select doc_id, sha1(replace(replace(regexp_replace(head, 'status: .*', 'status: active'), '  - x: y' || chr(10), '  - x: y' || chr(10) || 'seen: now' || chr(10)) || text, chr(13) || chr(10), chr(10))) as sha from p")
def page_patches(spark, sf):
    """One field replaced, one added."""
    page = FM.patched(FM.patched(F.col("content"), "status", F.lit("active")), "seen", F.lit("now"))
    return _pages(spark, sf).select("doc_id", F.sha1(page.cast("binary")).alias("sha"))


@query(f"with {_PAGE} select doc_id, left(sha1(text), 16) as body, left(sha1(head || text), 16) as page, left(sha1(rel || chr(0) || doc_id), 16) as id from p")
def page_digests(spark, sf):
    c = F.col("content")
    return _pages(spark, sf).select("doc_id", D.body_digest(c).alias("body"), D.short(c).alias("page"), D.row_id(F.col("rel"), F.col("doc_id").cast("string")).alias("id"))


@query("select doc_id // 500 as folder, lang, sha1(string_agg(text, '' order by doc_id)) as sha from documents group by all")
def folder_digests(spark, sf):
    """One digest over the texts of each folder, here five hundred ids, and language in order."""
    return _docs(spark, sf).withColumn("folder", F.floor(F.col("doc_id") / 500)).groupBy("folder", "lang").agg(D.combined(F.col("text"), F.col("doc_id")).alias("sha"))


@query("select conv_id, role, sha256(string_agg(length(text)::varchar || ':' || text, chr(10) order by turn)) as sha from conversations group by all")
def fingerprint(spark, sf):
    """Of the turns of each conversation, in order, by role."""
    return U.in_order_digest(table(spark, sf, "conversations"), ["turn"], F.col("text"), ("conv_id", "role"))


@query("select event_id, to_timestamp(floor(epoch(ts)))::timestamp as at, to_timestamp(floor(epoch(ts)))::timestamp as ms, (ts + interval 8 hour)::date as day from events")
def moments(spark, sf):
    """Seconds, milliseconds, and the day in a zone."""
    e = table(spark, sf, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return e.select("event_id", FM.epoch(F.col("s")).cast("timestamp_ntz").alias("at"), FM.epoch(F.col("s") * 1000).cast("timestamp_ntz").alias("ms"), FM.local_day(F.col("ts").cast("timestamp"), "+08:00").alias("day"))


# ------------------------------------------------------------------ sessions
@query(
    """with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'assistant'),
l as (select conv_id, turn as line_id, list_distinct(list_filter(regexp_extract_all(lower(left(text, 200)), '[a-z0-9]+'), lambda w: length(w) > 2)) as w from t),
m as (select l.conv_id, l.line_id, t.turn as turn_no, len(list_intersect(l.w, list_distinct(list_filter(regexp_extract_all(lower(t.text), '[a-z0-9]+'), lambda w: length(w) > 2)))) as n from l join t using (conv_id))
select conv_id as session, line_id, turn_no from (select *, row_number() over (partition by conv_id, line_id order by n desc, turn_no) as r from m) where r = 1"""
)
def turns_located(spark, sf):
    """For the beginning of each answer, the turn that shares most of its words."""
    t = table(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn"), "text", F.lit("").alias("hhmm"))
    lines = t.select("session", F.col("turn").alias("line_id"), "hhmm", F.substring("text", 1, 200).alias("text"))
    return S.located(lines, t.withColumnRenamed("turn", "turn_no").withColumnRenamed("text", "said"), T.latin_words(F.col("text")), T.latin_words(F.col("said")))


@query(
    """with a as (select distinct o_custkey as session, o_orderdate::date as day, 'p' || o_custkey || '-' || strftime(o_orderdate, '%j') || '-' || o_orderstatus as path from orders where o_orderkey % 2 = 0),
b as (select distinct o_custkey as session, o_orderdate::date as day, 'p' || o_custkey || '-' || strftime(o_orderdate, '%j') || '-F' as path from orders),
j as (select b.path, a.path as old from b left join a using (session, day))
select path, case when max((old is not null)::int) = 1 then 'replaced' else 'written' end as state from j group by path union all select distinct old, 'deleted' from j where old <> path and old not in (select path from b)"""
)
def renamed_pages(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus")
    path = lambda s: F.concat(F.lit("p"), "session", F.lit("-"), F.date_format("day", "DDD"), F.lit("-"), s)
    old = o.where("o_orderkey % 2 = 0").select("session", "day", path(F.col("o_orderstatus")).alias("path")).distinct()
    return S.replaced_by_day(old, o.select("session", "day", path(F.lit("F")).alias("path")).distinct())


@query(
    """with d as (select distinct user_id, ts::date as d from events where event_type = 'view'), g as (select user_id, d, d - (row_number() over (partition by user_id order by d))::int as k from d),
r as (select user_id, max(d) as last, count(*) as n from g group by user_id, k) select user_id, coalesce(max(case when last = date '2024-01-15' then n end), 0)::bigint as n_days from r group by user_id"""
)
def current_run(spark, sf):
    days = table(spark, sf, "events").where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day"))
    return S.current_run(days, ["user_id"], "day", "2024-01-15")


@query(
    """with e as (select event_id, ts, user_id as id, ts::date as day, lower(trim(regexp_replace(props || (event_id % 400), '\\s+', ' ', 'g'))) as f from events),
f as (select * from (select *, row_number() over (partition by f, day order by ts, id) as r from e) where r = 1),
n as (select *, row_number() over (partition by day order by ts, id) as n from f), b as (select *, lag(n) over (partition by day, id order by n) as b from n)
select event_id from b where b is null or n - b > 50"""
)
def asks_once(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("id"), F.to_date("ts").alias("day"), F.concat("props", F.col("event_id") % 400).alias("text"))
    return S.asks_once(e).select("event_id")


@query("select page_id, case when url like 'https:%' then regexp_extract(url, '^(https://[^/]*)', 1) else regexp_replace(url, '/+$', '') end as root from pages")
def project_roots(spark, sf):
    """Addresses as working folders, hosts as repositories."""
    rows = table(spark, sf, "pages").select("page_id", "url")
    tops = rows.where("url like 'https:%'").select(F.regexp_extract("url", "^(https://[^/]*)", 1).alias("prefix")).distinct()
    return S.project_roots(rows, "url", tops).select("page_id", "root")


# ------------------------------------------------------------------ upkeep
@query(
    """with led as (select o_custkey, o_orderkey as seq, case when o_orderkey % 4 = 3 then 'promote' else 'record' end as kind, case o_orderkey % 3 when 0 then 'adopt' when 1 then 'skip' else 'later' end as decision from orders where o_orderkey % 4 > 0),
la as (select o_custkey, arg_max(case when kind = 'promote' then 'promoted' else decision end, seq) as last from led group by o_custkey),
pg as (select c_custkey, case c_custkey % 5 when 0 then 'active' when 1 then 'Superseded by x' else 'provisional' end as status from customer where c_custkey % 7 > 0)
select 'c' || c.c_custkey || '.md' as file, reason in ('promoted', 'already-active') as active, reason from (select c.c_custkey, case when last is distinct from 'adopt' then 'need-adopt-first' when status is null then 'missing-page' when status = 'active' then 'already-active' when lower(status) like 'superseded%' then 'not-provisional' else 'promoted' end as reason from customer c left join la on la.o_custkey = c.c_custkey left join pg on pg.c_custkey = c.c_custkey) c"""
)
def promotions(spark, sf):
    name = lambda c: F.concat(F.lit("c"), c, F.lit(".md"))
    k = F.col("o_orderkey")
    ledger = table(spark, sf, "orders").where("o_orderkey % 4 > 0").select(name("o_custkey").alias("file"), k.alias("seq"), F.when(k % 4 == 3, "promote").otherwise("record").alias("kind"), F.when(k % 3 == 0, "adopt").when(k % 3 == 1, "skip").otherwise("later").alias("decision"))
    c = table(spark, sf, "customer").select("c_custkey")
    pages = c.where("c_custkey % 7 > 0").select(name("c_custkey").alias("file"), F.when(F.col("c_custkey") % 5 == 0, "active").when(F.col("c_custkey") % 5 == 1, "Superseded by x").otherwise("provisional").alias("status"))
    return U.promoted(c.select(F.concat(F.lit("c"), "c_custkey").alias("file")), ledger, pages)


@query("select count(*) as n, sum((p_size > 5)::int)::bigint as with_triggers, list_sort(list('p' || p_partkey) filter (where p_size <= 5)) is not null as some_missing, (count(*) filter (where p_size <= 5))::int as n_missing, false as ok from part")
def trigger_coverage(spark, sf):
    part = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("file"), F.when(F.col("p_size") > 5, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("triggers"))
    return U.trigger_coverage(part).select("n", "with_triggers", (F.size("missing") > 0).alias("some_missing"), F.size("missing").alias("n_missing"), "ok")


_HEALTH = "h as (select c_custkey as rel, c_custkey % 9 as k, strftime(date '2024-01-01' + (c_custkey % 300)::int, '%Y-%m-%d') as d from customer)"


@query(f"with {_HEALTH} select rel, case k when 0 then 'missing' when 1 then 'none' else d end as sealed, case when k between 1 and 4 then d end as through, case when k = 4 then 'three days' end as pending from h")
def seals(spark, sf):
    """Health pages of customers, with and without marked lines."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("rel"), (F.col("c_custkey") % 9).alias("k"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd").alias("d"))
    sealed = F.when(F.col("k") == 0, "# head").when(F.col("k") == 1, U.SEALED).otherwise(F.concat(F.lit(U.SEALED + "`"), "d", F.lit("`")))
    waits = F.when(F.col("k") == 4, F.concat(F.lit(U.PENDING + " `three days` to "), "d")).when(F.col("k").between(1, 4), F.concat(F.lit(U.PENDING + " to "), "d")).otherwise("")
    return U.seals(c.select("rel", F.concat_ws("\n", F.lit("# Health"), sealed, waits).alias("body")))


@query(f"with {_HEALTH} select rel, case when k = 0 then 'unset' when k < 5 then 'running' else 'idle' end as lamp, k <> 3 as writable, case when k = 6 then 'failed' when k = 7 then '' else 'ok' end as nightly, (k between 1 and 4 and d <= '2024-06-28') as stale, (k = 3 or k = 6 or (k between 1 and 4 and d <= '2024-06-28')) as act from h")
def lamps(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("rel"), (F.col("c_custkey") % 9).alias("k"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd").alias("d"))
    k = F.col("k")
    meta = F.create_map(
        F.lit("lamp"), F.when(k == 0, F.lit(None).cast("string")).when(k < 5, "running").otherwise("idle"), F.lit("key"), F.when(k == 3, "missing").otherwise("present"), F.lit("writer"), F.lit("present"),
        F.lit("nightly"), F.when(k == 6, "failed").when(k == 7, "").otherwise("ok"), F.lit("nightly_at"), F.concat("d", F.lit("T00:00:00")),
    )
    return U.lamps(c.select("rel", meta.alias("meta")), "2024-07-01 00:00:00")


@query(f"with {_PAGE}, l as (select p.rel, '[[' || o.rel || ']]' as ref, case when o.doc_id % 2 = 0 then o.rel end as hit from p join p o on o.doc_id = p.doc_id + 1) select ref, max(hit) as rel from l group by ref")
def references(spark, sf):
    """Links to the next page, of which only even ones are there."""
    p = _pages(spark, sf).select("doc_id", "rel")
    nxt = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("rel").alias("to"))
    refs = p.join(nxt, "doc_id").select(F.concat(F.lit("[["), "to", F.lit("]]")).alias("ref"))
    return U.resolved(refs, p.where("doc_id % 2 = 0").select("rel"))


@query(f"with {_PAGE} select p.rel, case when o.doc_id is null then 'see ' else case when o.doc_id % 2 = 0 then 'see [[' || o.rel || '#a|b]]' else 'see `' || o.rel || '#a|b`' end end as body, (o.doc_id is not null and o.doc_id % 2 = 1)::int as n_lost from p left join p o on o.doc_id = p.doc_id + 1")
def repaired_links(spark, sf):
    p = _pages(spark, sf).select("doc_id", "rel")
    nxt = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("rel").alias("to"))
    body = F.concat(F.lit("see "), F.coalesce(F.concat(F.lit("[["), "to", F.lit("#a|b]]")), F.lit("")))
    return U.repaired_links(p.join(nxt, "doc_id", "left").select("rel", body.alias("body")), p.where("doc_id % 2 = 0").select("rel"))


@query("with p as (select p_name || '.md' as rel from part group by p_name), o as (select split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' (old).md' as rel from part where p_size > 30 group by all) select p.rel, o.rel as old from p join o on o.rel = replace(p.rel, '.md', ' (old).md')")
def replaced_page(spark, sf):
    part = table(spark, sf, "part")
    pages = part.select(F.concat("p_name", F.lit(".md")).alias("rel")).union(part.where("p_size > 30").select(F.concat("p_name", F.lit(" (old).md")))).distinct()
    return U.replaced_page(pages)


@query(f"with {REDACTED} select doc_id as rel, case when lang <> 'de' then left(trim(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), 4000) end as view from r5 join documents using (doc_id)")
def learner_view(spark, sf):
    """All pages, redacted and in one line; those in German are said to be secret."""
    meta = F.create_map(F.lit("secret"), F.when(F.col("lang") == "de", "true").otherwise("false"), F.lit("title"), F.lit("t"))
    pages = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("rel"), meta.alias("meta"), F.col("text").alias("body"))
    return U.learner_view(pages).select(F.col("rel").cast("long").alias("rel"), "view")


@query(
    """with b as (select distinct doc_id, case doc_id % 3 when 0 then 'held' when 1 then 'same' else 'new' end as k from documents)
select doc_id::varchar as rel, case k when 'held' then 'kept' when 'same' then 'same' else 'written' end as state from b"""
)
def merged_pages(spark, sf):
    """Writing pages where a third is someone else's and a third is as it was."""
    d = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("rel"), F.concat(F.lit("source: mark\n"), "text").alias("content"), (F.col("doc_id") % 3).alias("k"))
    there = d.where("k < 2").select("rel", F.when(F.col("k") == 0, F.lit("mine")).otherwise(F.col("content")).alias("content"))
    return Q.merged_pages(d.select("rel", "content"), there, "source: mark").select("rel", "state")


@query(
    """with i as (select case when page_id % 2 = 0 then 'added' end as k, page_id as rel from pages),
a as (select doc_id as rel, n_chars as size from documents), b as (select doc_id as rel, case when doc_id % 3 = 0 then n_chars + 1 else n_chars end as size from documents where doc_id % 5 > 0)
select b.rel, b.size::bigint as size from b join a using (rel)"""
)
def refreshed_index(spark, sf):
    """An index after a refresh in which a fifth of the pages is gone and a third has changed."""
    old = _docs(spark, sf).select(F.col("doc_id").alias("rel"), F.col("n_chars").cast("long").alias("size"))
    new = old.where("rel % 5 > 0").withColumn("size", F.when(F.col("rel") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return I.refreshed(old, new, I.snapshot_diff(old, new, "rel", ["size"]), "rel")


# ------------------------------------------------------------------ grades
_MARKS = "g as (select o_orderkey as qid, case o_orderkey % 3 when 0 then 'refuse' when 1 then 'current' else 'correction' end as kind, case when o_orderkey % 3 > 0 then o_custkey % 7 end as gold, case when o_orderkey % 11 > 2 then (o_custkey + o_orderkey // 5) % 7 end as cited, floor(o_totalprice / 100)::double as score from orders)"


def _marks(spark, sf):
    """Orders as questions that are answered with a page or refused."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("qid"), F.when(k % 3 == 0, "refuse").when(k % 3 == 1, "current").otherwise("correction").alias("kind"), F.when(k % 3 > 0, F.col("o_custkey") % 7).alias("gold"), F.when(k % 11 > 2, (F.col("o_custkey") + F.floor(k / 5)) % 7).alias("cited"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("score"))
    return rows.select("qid", "kind", "gold"), rows.select("qid", "cited", "score")


@query(f"with {_MARKS}, x as (select *, cited is not null and score >= 1500 as answered from g) select kind, count(*) as n, sum(answered::int)::bigint as n_answered, sum((answered and cited is distinct from gold)::int)::bigint as n_wrong, sum((answered and cited is not distinct from gold)::int)::bigint as n_right, sum((not answered)::int)::bigint as n_refused, round(coalesce(sum((answered and cited is distinct from gold)::int)::double / nullif(sum(answered::int), 0), 0), 3) as wrong_rate from x group by kind")
def graded_with_floor(spark, sf):
    asked, answers = _marks(spark, sf)
    return E.summary(E.graded(asked, E.with_floor(answers, 1500.0)), "kind").where("kind <> 'all'")


@query(f"with {_MARKS}, r as (select *, row_number() over (order by cited is null, score desc, qid) as i from g) select qid, case when i <= 500 then cited end as cited from r")
def at_coverage(spark, sf):
    _, answers = _marks(spark, sf)
    return E.at_coverage(answers, 500).select("qid", "cited")


@query(f"with {_MARKS}, a as (select *, cited is not null as answered, cited is not distinct from gold as r from g), f as (select unnest(list_value(0.0, 1000.0, 2500.0)) as floor), t as (select floor::double as floor, coalesce(sum(case when r then 1 else -1 end) filter (where answered and score >= floor), 0) as p from f, a group by floor) select qid as left_out, floor, (p - case when answered and score >= floor then case when r then 1 else -1 end else 0 end)::bigint as points from a, t")
def leave_one_out(spark, sf):
    asked, answers = _marks(spark, sf)
    cuts = spark.createDataFrame([(0.0,), (1000.0,), (2500.0,)], "floor double")
    return E.leave_one_out(E.graded(asked, answers), cuts)


@query(
    f"""with {_MARKS}, i as (select *, coalesce(kind, 'x') as slice, case when qid % 4 = 0 then 3 end as old, case when qid % 5 = 0 then 2 end as trap from g),
f as (select slice, case when gold is null then cited is null else coalesce(cited = gold, false) end as e, cited is not null and cited is distinct from gold as fn, old is not null and coalesce(cited = old, false) as o, trap is not null and coalesce(cited = trap, false) as t, cited is null as m from i)
select coalesce(slice, 'all') as slice, count(*) as n, round(sum(e::int)::double / count(*), 4) as exact, round(sum(fn::int)::double / count(*), 4) as false_neighbor, round(sum(o::int)::double / count(*), 4) as old_page, round(sum(t::int)::double / count(*), 4) as trapped, round(sum(m::int)::double / count(*), 4) as miss from f group by rollup (slice)"""
)
def slice_rates(spark, sf):
    asked, answers = _marks(spark, sf)
    items = asked.select(F.col("qid").alias("id"), F.col("kind").alias("slice"), "gold", F.when(F.col("qid") % 4 == 0, 3).alias("old"), F.when(F.col("qid") % 5 == 0, 2).alias("trap"))
    return E.slices_exact(items, answers.select(F.col("qid").alias("id"), "cited"))


@query("with p as (select distinct l_orderkey % 400 as g, l_suppkey as s from lineitem), h as (select least(count(distinct g), count(distinct s)) as hits from p), w as (select count(distinct o_orderkey % 500) as n, count(distinct case when o_orderkey % 2 = 0 then o_orderkey % 500 end) as c from orders), l as (select count(*) as n from supplier), c as (select count(distinct o_orderkey % 500) as n from orders where o_orderkey % 2 = 0 and o_orderkey % 500 in (select g from p)) select hits, w.n as n_gold, l.n as n_lines, round(1 - hits::double / w.n, 3) as missed, round(1 - hits::double / l.n, 3) as wrong, c.n as changes, w.c as n_changes from h, w, l, c")
def capture_scores(spark, sf):
    pairs = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 400).alias("g"), F.col("l_suppkey").alias("s"))
    gold = table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("g"), (F.col("o_orderkey") % 2 == 0).alias("is_change"))
    return E.captured(pairs, gold, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s")))


@query("with r as (select l_shipdate::date as day, l_linenumber = 7 as refused, l_quantity > 10 as existed, l_tax < 0.05 as valid, l_orderkey % 3 as a, l_partkey % 3 as b from lineitem), p as (select strftime(day, '%Y-%m') as month, case when refused then case when existed then 0.0 else 2.0 end when not existed or not valid then 0.0 else (a + b) / 2.0 end as points from r) select coalesce(month, 'all') as month, count(*) as n, round(avg(points), 3) as points from p group by rollup (month)")
def judge_months(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_linenumber") == 7).alias("refused"), (F.col("l_quantity") > 10).alias("existed"), (F.col("l_tax") < 0.05).alias("valid"), (F.col("l_orderkey") % 3).alias("first"), (F.col("l_partkey") % 3).alias("second"))
    return E.judged_by_month(rows)


@query(
    """with v as (select l_orderkey as qid, l_shipdate::date as day, case when l_linenumber % 2 = 0 then 'a' else 'b' end as system, l_linenumber as pass, l_returnflag = 'R' as refused, l_quantity > 10 as existed, l_tax > 0.06 as invalid, l_partkey % 4 as points from lineitem),
p as (select *, case when refused then case when existed then 0 else 2 end when invalid or not existed then 0 when points in (0, 1, 2) then points else 0 end as score from v),
e as (select qid, min(strftime(day, '%Y-%m')) as month, avg(case when system = 'a' then score end) as a, avg(case when system = 'b' then score end) as b, arg_min(existed, pass * 2 + existed::int)::int as ex from p group by qid),
m as (select month, count(case when a is not null and b is not null then 1 end) as n, round(avg(case when b is not null then a end), 3) as mean_a, round(avg(case when a is not null then b end), 3) as mean_b, round(avg(ex), 3) as existed from e group by rollup (month))
select coalesce(month, 'all') as month, n, mean_a, mean_b, existed from m where n > 0 or month is null"""
)
def judged_duel(spark, sf):
    """Two systems by a judge's passes, by month."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("system"), F.col("l_linenumber").alias("pass"),
        (F.col("l_returnflag") == "R").alias("refused"), (F.col("l_quantity") > 10).alias("existed"), (F.col("l_tax") > 0.06).alias("invalid"), (F.col("l_partkey") % 4).alias("points"),
    )
    return E.duel(rows, "a", "b", None)


@query(
    f"""with {_MARKS}, d as (select gold as k from (values (1), (4)) t(gold)), r as (select kind as qid, qid % 50 as key, min(qid % 1000) as rank from g group by all), k as (select qid, key, row_number() over (partition by qid order by rank, key) as rank from r),
x as (select qid, key, rank from k where key not in (select k from d))
select qid, key, row_number() over (partition by qid order by rank)::int as rank from x"""
)
def ranks_without_dead(spark, sf):
    asked, _ = _marks(spark, sf)
    first = asked.groupBy(F.col("kind").alias("kind"), (F.col("qid") % 50).alias("key")).agg(F.min(F.col("qid") % 1000).alias("m"))
    ranked = first.select(F.col("kind").alias("qid"), "key", F.row_number().over(W.partitionBy("kind").orderBy("m", "key")).alias("rank"))
    return E.without_dead(ranked, spark.createDataFrame([(1,), (4,)], "key long"), "key")


@query(
    f"""with {_MARKS}, a as (select qid, cited as a from g where score > 1000 and cited is not null), b as (select qid, (cited + qid) % 7 as b from g where qid % 3 > 0 and cited is not null)
select qid, coalesce(a, b) as rescue, case when b is not null then a end as gate, case when a = b then a end as agree from a full join b using (qid)"""
)
def two_systems(spark, sf):
    _, answers = _marks(spark, sf)
    a = answers.where("score > 1000 and cited is not null").select("qid", "cited")
    b = answers.where("qid % 3 > 0 and cited is not null").select("qid", ((F.col("cited") + F.col("qid")) % 7).alias("cited"))
    out = [V.decide(a, b, r).withColumnRenamed("cited", r) for r in ("rescue", "gate", "agree")]
    return out[0].join(out[1], "qid").join(out[2], "qid")


@query(f"with {_MARKS}, t as (select gold, qid, row_number() over (partition by gold order by qid) as week, count(*) over (partition by gold) as n from g where gold is not null) select gold::varchar as intent, week::int as week, qid from t where n >= 2 and week <= 2 union all select qid::varchar, w, qid from g, (select unnest(list_value(1, 2)) as w) where gold is null")
def question_pairs(spark, sf):
    asked, _ = _marks(spark, sf)
    return E.question_pairs(asked)


@query(
    """with t as (select l_orderkey as session, ['even', 'odd', 'none'][1 + (l_orderkey % 3)::int] as stratum, count(*) as n, count(*) filter (where l_quantity > 10) as a from lineitem group by l_orderkey),
f as (select stratum, session, row_number() over (partition by stratum order by md5('7:' || session), session) as k from t where n between 3 and 7 and a >= 0.7 * n)
select stratum, session, k from f where k <= case stratum when 'even' then 40 when 'odd' then 25 else 0 end"""
)
def sample_frame(spark, sf):
    """Sessions drawn for judging, up to a quota of each stratum, in their seeded order."""
    stratum = F.element_at(F.array(F.lit("even"), F.lit("odd"), F.lit("none")), (1 + F.col("session") % 3).cast("int"))
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.count("*").alias("n_turns"), F.count(F.when(F.col("l_quantity") > 10, 1)).alias("n_answered")).withColumn("stratum", stratum)
    return U.capture_sample(s, {"even": 40, "odd": 25}, 7, 3, 7).select("stratum", "session", F.col("place").cast("long").alias("k"))
