"""Queries over logs and pages: turns, days, budgets, streaks, state, digests, redaction, links."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import digest as D
from recollect.functions import redact as X
from recollect.operators import changes as C
from recollect.operators import index as I
from recollect.operators import quality as Q
from recollect.operators import sessions as S
from recollect.plans.registry import query, table


# ------------------------------------------------------------------ sessions
@query(
    """with t as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as turn_no from conversations)
select conv_id, turn_no::bigint as turn_no, max(case when role = 'user' then text end) as ask, arg_max(text, turn) filter (where role = 'assistant' and length(trim(text)) > 0) as answer from t where turn_no > 0 group by conv_id, turn_no"""
)
def turns_last_answer(spark, sf):
    return S.turns(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", "text")


@query("select user_id, ts::date as day, count(*) as n, round(sum(value), 2) as total, count(distinct event_type) as kinds from events group by all")
def sessions_by_day(spark, sf):
    return S.by_day(table(spark, sf, "events"), ["user_id"], F.to_date("ts"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.countDistinct("event_type").alias("kinds"))


@query(
    """with r as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn, role rows unbounded preceding) as running, length(text) as n from conversations)
select conv_id, turn, running::bigint as running, n::bigint as n from r where running - n <= 600"""
)
def running_budget(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return S.running_budget(rows, "conv_id", ["turn", "role"], F.col("n"), 600, True).select("conv_id", "turn", "running", "n")


@query(
    """with r as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn, role rows unbounded preceding) as running, length(text) as n from conversations)
select conv_id, turn, running::bigint as running, n::bigint as n from r where running <= 600"""
)
def evidence_budget(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return S.running_budget(rows, "conv_id", ["turn", "role"], F.col("n"), 600, False).select("conv_id", "turn", "running", "n")


@query(
    """with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn, length(text)) as i, length(text) as n from conversations),
r as (select conv_id, i, n as size, 0 as segment from t where i = 1
union all select t.conv_id, t.i, case when size > 0 and size + n > 500 then n else size + n end, segment + (size > 0 and size + n > 500)::int from r join t on t.conv_id = r.conv_id and t.i = r.i + 1)
select conv_id, segment, count(*) as n from r group by conv_id, segment"""
)
def turn_segments(spark, sf):
    """Greedy packing of turns."""
    return S.segments(table(spark, sf, "conversations"), "conv_id", "turn", "text", 500)


@query("select md5(text) as h, min(doc_id) as doc_id, count(*) as copies from documents group by md5(text)")
def first_seen_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    n = docs.groupBy("h").agg(F.count("*").alias("copies"))
    return S.first_seen(docs, ["h"], ["doc_id"]).join(n, "h").select("h", "doc_id", "copies")


@query(
    """with d as (select distinct user_id, ts::date as d from events where event_type = 'purchase'), g as (select user_id, d, d - (row_number() over (partition by user_id order by d))::int as k from d)
select user_id, min(d) as first_day, max(d) as last_day, count(*) as n_days from g group by user_id, k"""
)
def sealed_streaks(spark, sf):
    days = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return S.streaks(days, ["user_id"], "day")


@query(
    """with d as (select ts::date as day, min(case when event_type = 'purchase' and value > 490 then 1 when event_type = 'signup' and value > 495 then 2 when event_type = 'error' then 3 else 4 end) as k from events group by all)
select c.day, coalesce(list_value('sealed', 'empty', 'stub', 'other')[k], 'missing') as state from (select unnest(generate_series(date '2023-12-30', date '2024-02-02', interval 1 day))::date as day) c left join d on d.day = c.day"""
)
def gap_calendar(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    days = S.days_classified(e, "day", (F.col("event_type") == "purchase") & (F.col("value") > 490), F.col("event_type") == "error", (F.col("event_type") == "signup") & (F.col("value") > 495))
    return S.calendar("2023-12-30", "2024-02-02", days, "day").fillna("missing", ["state"])


_STATE = """with e as (select *, max(case when event_type = 'view' then ts end) over w as asked, max(case when event_type = 'view' then {ts: ts, id: event_id} end) over w as a, max(case when event_type = 'purchase' then {ts: ts, id: event_id} end) over w as c from events
window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
"""


@query(_STATE + "select event_id, user_id, (asked is not null and ts - interval 24 hour <= asked and (c is null or c < a)) as repeated from e where event_type = 'view'")
def already_asked_24h(spark, sf):
    e = S.suppressed(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")
    return e.select("event_id", "user_id", "repeated")


@query("select user_id, arg_max(event_type, {ts: ts, id: event_id}) as state from events where event_type in ('view', 'purchase', 'signup') group by user_id")
def last_decision(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('view', 'purchase', 'signup')")
    return S.last_state(e, "user_id", ["ts", "event_id"], "event_type")


@query(
    """with o as (select o_custkey, o_orderkey, o_orderdate from orders), b as (select o_custkey, o_orderdate + interval 1 day as at, max(o_orderkey) as prev from orders group by all)
select o_orderkey, prev from o asof left join b on o.o_custkey = b.o_custkey and o.o_orderdate >= b.at"""
)
def asof_backup(spark, sf):
    """For each order the customer's last one a day or more before it."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    b = o.groupBy("o_custkey", (F.col("at") + F.expr("interval 1 day")).alias("since")).agg(F.max("o_orderkey").alias("prev"))
    return S.as_of(o, b, "o_custkey", "at", "since", "prev").select("o_orderkey", "prev")


@query("select o_custkey, o_orderkey, n::int as n from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) where n <= 3")
def newest_decisions(spark, sf):
    return S.newest(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "n")


@query(
    """with o as (select user_id as session, event_id as seq, case when user_id % 10 > 0 then 'p' || user_id % 10 else '' end as project, case when user_id % 3 > 0 then '/r' || user_id % 3 end as root,
case event_type when 'view' then 'decision' when 'click' then 'change' when 'purchase' then 'feature' else event_type end as type, case when event_id % 17 = 0 then '' else props end as title, case when event_id % 5 > 0 then ts end as at_ from events),
d as (select case when project = '' then '?' else project end as project, coalesce(root, '') as root, session, seq, type, title, at_ from o where type in ('decision', 'change', 'feature', 'bugfix', 'refactor') and title <> ''),
r as (select *, row_number() over (partition by project, root order by at_ desc nulls last, session, seq) as n from d)
select project, root, case when root = '' then '' else left(sha1(root), 6) end as tag, n::int as n, session, type, title, at_ as "at" from r where n <= 120"""
)
def project_decisions(spark, sf):
    """The newest decisions of each project and folder, those without a time last."""
    kinds = F.when(F.col("event_type") == "view", "decision").when(F.col("event_type") == "click", "change").when(F.col("event_type") == "purchase", "feature").otherwise(F.col("event_type"))
    user = F.col("user_id")
    rows = table(spark, sf, "events").select(
        user.alias("session"), F.col("event_id").alias("seq"), F.when(user % 10 > 0, F.concat(F.lit("p"), user % 10)).otherwise("").alias("project"), F.when(user % 3 > 0, F.concat(F.lit("/r"), user % 3)).alias("root"),
        kinds.alias("type"), F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("props")).alias("title"), F.when(F.col("event_id") % 5 > 0, F.col("ts").cast("timestamp_ntz")).alias("at"),
    )
    return S.decisions(rows)


@query("select user_id, count(*) as n, max(ts) as last from events where event_type = 'view' group by user_id having count(*) >= 2 order by max(ts) desc, user_id limit 40")
def sessions_to_distill(spark, sf):
    """The forty sessions with the newest last turns, of two turns or more (a top-k report)."""
    turns = table(spark, sf, "events").where("event_type = 'view'").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return S.to_distill(turns, "user_id", "ts")


@query("select user_id, arg_min(event_type, event_id) as first_event_type, arg_max(event_type, event_id) as last_event_type, count(*) as n from events group by user_id")
def session_roll_up(spark, sf):
    return S.roll_up(table(spark, sf, "events"), "user_id", "event_id", ["event_type"], ["event_type"])


# ------------------------------------------------------------------ pages
@query("select doc_id, substring(sha1(text), 1, 16) as body_sha, sha256(text) as file_sha, substring(sha1(source || chr(1) || lang || chr(1) || text), 1, 16) as row_id from documents")
def digests(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", D.short(t).alias("body_sha"), D.file_digest(t).alias("file_sha"), D.short(F.concat_ws("\u0001", "source", "lang", "text")).alias("row_id"))


@query("select sha1(text) as sha, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by sha1(text) having count(*) > 1")
def dup_by_hash(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha"))
    return t.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query(
    """with a as (select page_id as rel, length(html) as size from pages), b as (select doc_id as rel, n_chars as size from documents)
select coalesce(a.rel, b.rel) as rel, case when a.rel is null then 'added' when b.rel is null then 'removed' when a.size = b.size then 'unchanged' else 'changed' end as state from a full join b using (rel)"""
)
def snapshot_diff(spark, sf):
    """Web pages as the old snapshot and documents as the new one, by id and size."""
    old = table(spark, sf, "pages").select(F.col("page_id").alias("rel"), F.length("html").cast("long").alias("size"))
    new = table(spark, sf, "documents").select(F.col("doc_id").alias("rel"), F.col("n_chars").alias("size"))
    return I.snapshot_diff(old, new, "rel", ["size"])


# Redaction in SQL: a text is split at a pattern's matches; each match is judged by itself. The expression
# engine has no look-around, so what needs it is written as conditions.
_LABEL = "(?:[A-Za-z0-9_]*(?:API[_ -]?KEY|APIKEY|ACCESS[_ -]?KEY|SECRET[_ -]?KEY|PRIVATE[_ -]?KEY|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIALS?)[A-Za-z0-9_]*|\\bkey\\b|密钥|秘钥|私钥|密码|口令|令牌|凭据|凭证|访问密钥)"
_SQL_ASSIGN = f"(?i)({_LABEL}[\"''`]?\\s*(?:[:=：]|\\s)\\s*[\"''`]?)([^\\s\"''`,;|)）]+)"
_SQL_QUERY = "(?i)([?&](?:key|api_?key|apikey|token|access_token|secret|password|sig|signature|auth)=)([^&#\\s]+)"
_SQL_CONN = "(?i)(\\b[a-z][a-z0-9+.-]*://[^:/\\s@]+:)([^@\\s/]+)@"
_SQL_KNOWN = "sk-(?:ant-|proj-|or-)?[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|glpat-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{20,}|xai-[A-Za-z0-9]{20,}|gsk_[A-Za-z0-9]{20,}|pplx-[A-Za-z0-9]{20,}|nvapi-[A-Za-z0-9_-]{20,}|csk-[A-Za-z0-9]{20,}|fw_[A-Za-z0-9]{16,}"
_SQL_PLAIN = "(?i)^(?:YOUR_|CHANGE_?ME|REPLACE|TODO|PASTE_|sk-your|x{4,}|<|\\.\\.\\.|…|\\*{3,})"


def _judged(t: str, pattern: str, hide: str, put: str) -> str:
    """``t`` with each match ``m`` of the pattern replaced by ``put`` where ``hide`` holds."""
    return f"(select string_agg(coalesce(x, '') || coalesce(case when {hide} then {put} else m end, ''), '' order by i) from (select unnest(string_split_regex({t}, '{pattern}')) as x, unnest(regexp_extract_all({t}, '{pattern}')) as m, generate_subscripts(string_split_regex({t}, '{pattern}'), 1) as i))"


def _hidden(v: str) -> str:
    return f"not regexp_matches({v}, '{_SQL_PLAIN}') and not contains({v}, '<redacted>') and not regexp_matches({v}, '^[一-鿿\\W]+$') and ((length({v}) >= 12 and not regexp_matches({v}, '^[0-9]+$')) or (length({v}) >= 6 and regexp_matches({v}, '[A-Za-z]') and regexp_matches({v}, '[0-9]')))"


def _lead(pattern: str, end: str = "") -> str:
    return f"regexp_extract(m, '{pattern}', 1) || '<redacted>{end}'"


_PIECE = "len(list_filter(regexp_split_to_array(m, '[-_./]'), lambda p: length(p) >= 16 and len(regexp_extract_all(p, '[A-Za-z]')) >= 2 and len(regexp_extract_all(p, '[0-9]')) >= 2)) > 0"
_MIXED = f"not regexp_matches(m, '(?i)^sha(?:1|256|384|512)[-:]') and not regexp_full_match(replace(m, '-', ''), '[0-9a-fA-F]+') and not regexp_matches(m, '^(?:/|~/|\\./|\\.\\./|[A-Za-z][A-Za-z0-9+.-]*://)') and not regexp_matches(m, '\\.[A-Za-z][A-Za-z0-9]{{0,5}}$') and {_PIECE}"
_VALUE = lambda p: f"regexp_extract(m, '{p}', 2)"
REDACTED = f"""r1 as (select doc_id, {_judged("text", _SQL_CONN, f"not regexp_matches({_VALUE(_SQL_CONN)}, '{_SQL_PLAIN}')", _lead(_SQL_CONN, "@"))} as t from documents),
r2 as (select doc_id, {_judged("t", _SQL_QUERY, _hidden(_VALUE(_SQL_QUERY)), _lead(_SQL_QUERY))} as t from r1),
r3 as (select doc_id, {_judged("t", _SQL_ASSIGN, _hidden(_VALUE(_SQL_ASSIGN)), _lead(_SQL_ASSIGN))} as t from r2),
r4 as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^A-Za-z0-9])(?:{_SQL_KNOWN})', '\\1<redacted>', 'g'), '(?i)\\b(bearer\\s+)[A-Za-z0-9._~+/=-]{{16,}}', '\\1<redacted>', 'g') as t from r3),
r5 as (select doc_id, {_judged("t", "[A-Za-z0-9+/=_.~:-]{16,}", _MIXED, "'<redacted>'")} as t from r4)
"""


@query(f"with r as (select doc_id, {_judged('text', _SQL_ASSIGN, _hidden(_VALUE(_SQL_ASSIGN)), _lead(_SQL_ASSIGN))} as t from documents) select doc_id, sha1(t) as sha from r")
def redact_labels(spark, sf):
    """Values behind labels alone."""
    return table(spark, sf, "documents").select("doc_id", F.sha1(X.redact_labelled(F.col("text")).cast("binary")).alias("sha"))


@query("with " + REDACTED + "select doc_id, ((length(t) - length(replace(t, '<redacted>', ''))) / 10)::int as n_redacted, sha1(t) as sha from r5")
def redact_full(spark, sf):
    """All passes."""
    text = X.redact(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text")).select("doc_id", ((F.length("text") - F.length(F.replace("text", F.lit(X.MARK), F.lit("")))) / len(X.MARK)).cast("int").alias("n_redacted"), F.sha1(F.col("text").cast("binary")).alias("sha"))


@query("select doc_id from documents where regexp_matches(split_part(source || '/' || split_part(text, chr(10), 1), '/', -1), '(?i)凭据|凭证|密钥|秘钥|私钥|钥匙|口令|credential|secret|password|passwd|api[ _-]?key') or lang = 'es' and doc_id % 7 = 0")
def secret_pages(spark, sf):
    """By name (the source and the first line as a path) or a flag in the head."""
    docs = table(spark, sf, "documents").withColumn("rel", F.concat("source", F.lit("/"), F.substring_index("text", "\n", 1)))
    return docs.where(X.is_secret_page(F.col("rel"), F.lit(""), F.when((F.col("lang") == "es") & (F.col("doc_id") % 7 == 0), "Yes"))).select("doc_id")


@query(
    """with l as (select page_id as src, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as target from pages), s as (select distinct split_part(url, '/', 4) as target from pages)
select target, count(*) as n from l where target not in (select target from s where target is not null) group by target"""
)
def link_check(spark, sf):
    """Links to the first folder of no known address."""
    pages = table(spark, sf, "pages")
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    known = pages.select(F.get(F.split("url", "/"), F.lit(3)).alias("rel")).where("rel is not null")
    return Q.broken_links(links, known).groupBy("target").agg(F.count("*").alias("n"))


_EDGES = """with o as (select o_custkey, o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as old, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as new from orders),
ed as (select 'o' || o_orderkey || '.md' as new, 'o' || old || '.md' as old from o where old is not null and o_orderkey % 2 = 0 union select 'o' || new || '.md', 'o' || o_orderkey || '.md' from o where new is not null and o_orderkey % 3 = 0)
"""


@query(_EDGES + "select new, old from ed")
def supersede_edges(spark, sf):
    """Orders as pages whose heads name the customer's order before them, or the next one."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("old"), F.lead("o_orderkey").over(w).alias("new"))
    link = lambda c, on: F.when(F.col(c).isNotNull() & on, F.concat(F.lit("[[o"), c, F.lit("]]")))
    meta = F.create_map(F.lit("supersedes"), link("old", F.col("o_orderkey") % 2 == 0), F.lit("superseded_by"), link("new", F.col("o_orderkey") % 3 == 0))
    return Q.supersede_edges(o.select(F.concat(F.lit("o"), "o_orderkey", F.lit(".md")).alias("rel"), meta.alias("meta")))


@query(
    """with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
e as (select o_custkey, o_orderkey as old, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as new from orders)
select e.new, e.old, a.rank::int as new_rank, b.rank::int as old_rank, a.rank < b.rank as ok from e join r a on a.o_orderkey = e.new join r b on b.o_orderkey = e.old"""
)
def tenure(spark, sf):
    """Whether an order's successor outranks it by price."""
    o = table(spark, sf, "orders")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = o.select("o_custkey", F.col("o_orderkey").alias("key"), rank.alias("rank"))
    nxt = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = o.select(F.col("o_orderkey").alias("old"), nxt.alias("new")).where("new is not null")
    own = rows.select(F.col("key").alias("qid"), "key", "rank")
    succ = edges.join(rows.select(F.col("key").alias("new"), "rank"), "new").select(F.col("old").alias("qid"), F.col("new").alias("key"), "rank")
    return Q.tenure(edges, own.unionByName(succ))


# Lines of a customer: what a queue runs, and changes of it.
_QUEUE = """with l as (select o_custkey as root, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey as seq, {{d: strftime(o_orderdate, '%Y-%m-%d'), s: o_orderkey}} as at, o_orderkey % 3 = 0 as plain, 'code' || (o_orderkey // 3 % 4) as a, 'code' || (o_orderkey // 12 % 4) as b from orders),
m as (select l.root, l.day, l.seq, l.plain, l.a, l.b, max(case when not x.plain and x.a = l.a and x.a <> x.b then x.at end) as f, max(case when not x.plain and x.b = l.a and x.a <> x.b then x.at end) as g, max(case when not x.plain and x.a = l.b then 1 end) as h from l left join l x on x.root = l.root and x.at > l.at group by all),
st as (select root, day, seq, plain, a, b, case when plain and f is not null and (g is null or g <= f) then 'replaced' when not plain and a <> b and h = 1 then 'replaced' else 'holds' end as state from m)
"""


def _queue_lines(spark, sf):
    k = F.col("o_orderkey")
    code = lambda n: F.concat(F.lit("code"), F.floor(k / n) % 4)
    line = F.when(k % 3 == 0, F.concat(F.lit("queue runs "), code(3))).otherwise(F.concat(F.lit("was queue "), code(3), F.lit(" → now queue "), code(12)))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("root"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), k.alias("seq"), line.alias("line"))


@query(_QUEUE.replace("{{", "{").replace("}}", "}") + "select root, day, seq, state from st")
def change_staleness(spark, sf):
    return C.stale(_queue_lines(spark, sf)).select("root", "day", "seq", "state")


@query(
    _QUEUE.replace("{{", "{").replace("}}", "}")
    + """, t as (select *, case when plain then 'queue runs ' || a else 'was queue ' || a || ' → now queue ' || b end as line from st),
fr as (select * from t where day::date >= date '1997-12-02' and (seq % 2 = 0 or not plain) and state <> 'replaced'),
o1 as (select * from (select *, row_number() over (partition by root, line order by day desc, seq) as r from fr) where r = 1)
select root, seq, n::int as n from (select *, row_number() over (partition by root order by (not plain)::int desc, day desc, seq) as n from o1) where n <= 8"""
)
def lines_to_inject(spark, sf):
    """Even orders' lines as confirmed ones, of the thirty days before 1998."""
    lines = C.stale(C.recent(_queue_lines(spark, sf), "1998-01-01")).withColumn("confirmed", F.col("seq") % 2 == 0).withColumn("day", F.to_date("day"))
    return C.to_inject(lines, "1998-01-01").select("root", "seq", "n")


@query("select case when quality is null then 'all' else quality::varchar end as quality, count(*) as n, sum(toxic)::bigint as n_toxic, round(sum(toxic)::double / count(*), 3) as toxic_rate from labels group by rollup (quality)")
def conditional_rates(spark, sf):
    from recollect.operators.evaluate import rate

    out = table(spark, sf, "labels").rollup("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"), rate(F.sum("toxic"), F.count("*")).alias("toxic_rate"))
    return out.withColumn("quality", F.coalesce(F.col("quality").cast("string"), F.lit("all")))


@query(
    """with s as (select user_id, case event_type when 'error' then case when value > 450 then 0 else 2 end when 'signup' then 1 else 3 end as k from events)
select user_id, list_value('failed', 'skipped', 'degraded', 'ok')[min(k) + 1] as state from s group by user_id"""
)
def worst_state(spark, sf):
    state = F.when((F.col("event_type") == "error") & (F.col("value") > 450), "failed").when(F.col("event_type") == "error", "degraded").when(F.col("event_type") == "signup", "skipped").otherwise("ok")
    return Q.worst(table(spark, sf, "events").withColumn("state", state), "user_id")


@query(
    """with l as (select doc_id as rel, source as topic, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
t as (select * from (values ('licence', 'licensed'), ('licence', 'license'), ('rights', 'rights reserved')) t(topic, term)),
h as (select distinct t.topic, rel, line_no, line from l join t on contains(lower(line), term)),
r as (select *, row_number() over (partition by topic, rel order by line_no) as r, count(*) over (partition by topic, rel) as n from h),
s as (select *, sum(length(line)) over (partition by topic order by n desc, rel, line_no rows unbounded preceding) as total from r where r <= 12)
select topic, rel, line_no::int as line_no, line from s where total <= 3000"""
)
def topic_evidence(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("rel"), F.lit(0).alias("day"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    terms = spark.createDataFrame([("licence", "licensed"), ("licence", "license"), ("rights", "rights reserved")], "topic string, term string")
    return Q.gather(lines, terms, budget=3000)


@query("select props as q, min(ts) as ts from events where ts > timestamp '2024-01-10' and event_type = 'error' group by props order by min(ts), props limit 40")
def weak_queries(spark, sf):
    """The first forty questions without an answer after a cursor (a report)."""
    log = table(spark, sf, "events").select(F.col("props").alias("q"), "ts", F.when(F.col("event_type") == "error", "none").otherwise("high").alias("confidence"))
    return Q.weak_queries(log.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "2024-01-10")


@query(
    """with n as (select conv_id, role, text, row_number() over (partition by role order by conv_id, turn) as i from conversations),
b as (select role, (i - 1) // 6 as k, string_agg(text, chr(10) || chr(10) order by i) as prompt from n group by all)
select role, count(*) as calls, sum(length(prompt))::bigint as chars, ceil(sum(length(prompt)) / 1.6)::bigint as tokens from b group by role"""
)
def prompt_cost(spark, sf):
    """What asking a model about all turns in batches would cost, by role."""
    from recollect.plans import nightly

    rows = table(spark, sf, "conversations").select("role", F.struct("conv_id", "turn").alias("k"), "text")
    out = nightly.cost(nightly.batches(rows, "k", "text", 6, by="role"), "role")
    return out.select("role", "calls", F.col("chars").cast("long").alias("chars"), F.col("tokens").cast("long").alias("tokens"))


# ------------------------------------------------------------------ the engine
def _page_table(spark, sf):
    head = F.concat(F.lit("---\ntitle: "), F.substring_index("text", "\n", 1), F.lit("\nstatus: "), F.when(F.col("quality") == 0, "superseded").otherwise("current"), F.lit("\n---\n"))
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("rel"), F.concat(head, "text").alias("content"))


@query()
def engine_ask(spark, sf):
    """Lock, recall with refusal and confidence for all benchmark texts over all documents.

    The refusal rules go by look-around patterns and Unicode forms, which SQL lacks."""
    from recollect.plans import engine

    index = engine.Index.build(_page_table(spark, sf), [("src0/", "rule"), ("src1/", "topic"), ("src2/", "project"), ("src3/", "log")])
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    aliases = spark.createDataFrame([("a1", "licence terms", "src0/0.md")], "id string, alias string, source string")
    return engine.ask(index, asked, aliases)
