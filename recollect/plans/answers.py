"""Queries over answer cards and secrets: documents as pages, benchmark texts as cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import redact as X
from recollect.functions import text as T
from recollect.operators import cards as C
from recollect.operators import quality as Q
from recollect.operators import sessions as S
from recollect.plans.memory import REDACTED
from recollect.plans.place import place
from recollect.plans.registry import query, table

_LITERAL = "'`[^`]+`|[A-Za-z0-9][A-Za-z0-9_./:~+#-]*[A-Za-z0-9]|[0-9]'"
_STOP = "list_value(" + ", ".join(f"'{w}'" for w in T.ENGLISH_FUNCTION) + ")"
_WORDS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 1)"
# A text stands as a whole where no letter or number goes on beside it; there is no look-around, so what may
# stand before and behind it is written out.
_BEFORE = "case when regexp_matches({0}, '^[0-9]') then '(^|[^0-9_.]|^[.]|[^0-9][.])' when regexp_matches({0}, '^[a-z]') then '(^|[^a-z0-9_])' else '' end"
_BEHIND = "case when regexp_matches({0}, '[a-z0-9]$') then '($|[^a-z0-9_.]|[.]$|[.][^0-9])' else '' end"
_STANDS = f"regexp_matches({{1}}, {_BEFORE} || regexp_escape({{0}}) || {_BEHIND})"
_SECRET = "(regexp_matches({0}, '(?i)sk-[A-Za-z0-9_-]{{12,}}|bearer\\s+\\S+|api[_-]?key\\s*[=:]|password\\s*[=:]|token\\s*[=:]') or len(list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9]+'), lambda p: length(p) >= 24 and regexp_matches(p, '[A-Za-z]') and regexp_matches(p, '[0-9]'))) > 0)"

# A card for every benchmark text and three documents: one that holds its first long line, if any does, and two others.
_CARDS = f"""
b as (select item_id, text, substring(text, 1, 60) as head, substring(text, 21, 110) as mid from benchmark),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
gold as (select item_id, min(doc_id) as rel from (select item_id, unnest(string_split(text, chr(10))) as line from b) x join lines using (line) where length(line) >= 40 group by item_id),
n as (select max(doc_id) + 1 as n from documents),
o as (select item_id, rel, 0 as k from gold union all select item_id, (item_id * 7 + k * 31) % n as rel, k from b, n, (select unnest([1, 2]) as k)),
c as (select item_id, k, o.rel, case when item_id % 11 = 5 then 'old' else substring(sha1(d.text), 1, 16) end as sha,
case when item_id % 4 = 3 then 'was ist' else head end as q,
case item_id % 6 when 1 then mid || ' after 4521.7 hours' when 2 then mid || ' password: tiger' when 3 then '--' when 4 then split_part(head, ' ', 1) || '/' || split_part(head, ' ', 2) else mid end as a,
item_id % 13 = 4 as empty, case when item_id % 3 = 0 then 1 end as v, d.text as page, substring(sha1(d.text), 1, 16) as now
from b join o using (item_id) join documents d on d.doc_id = o.rel),
s as (select item_id, k, list_distinct(list_filter(list_transform(regexp_extract_all(replace(a, '：', ' '), {_LITERAL}), lambda x: case when starts_with(x, '`') then trim(replace(x, '`', '')) else case when regexp_matches(x, '[0-9./_:~#]') or length(x) >= 3 then x else '' end end), lambda x: x <> '')) as said from c),
e as (select item_id, k, unnest(list_transform(said, lambda x: lower(x))) as x from s),
w as (select e.*, lower(page) as p from e join c using (item_id, k)),
parts as (select item_id, k, x, p, list_filter(regexp_split_to_array(x, '[/+]'), lambda y: y <> '') as y from w),
u as (select item_id, k, x, bool_and(length(y) > 1 and regexp_matches(y, '[a-z]') and {_STANDS.format("y", "p")}) and count(*) > 1 as ok from (select item_id, k, x, p, unnest(y) as y from parts) group by item_id, k, x),
f as (select w.item_id, w.k, bool_and({_STANDS.format("w.x", "w.p")} or coalesce(ok, false)) as ok from w left join u on u.item_id = w.item_id and u.k = w.k and u.x = w.x group by w.item_id, w.k),
j as (select c.*, coalesce(f.ok, true) as faithful, len(said) as n_said, {_WORDS.format("page")} as known, {_WORDS.format("a")} as words, list_distinct({_WORDS.format("q")}) as asked from c join s using (item_id, k) left join f using (item_id, k)),
g as (select *, faithful and len(list_intersect(asked, known)) > 0 and len(list_filter(words, lambda x: list_contains(known, x))) >= 0.3 * len(words) as grounded,
len(list_filter(case when len(list_filter(asked, lambda x: not list_contains({_STOP}, x))) > 0 then list_filter(asked, lambda x: not list_contains({_STOP}, x)) else asked end, lambda x: not regexp_full_match(x, '[0-9]+'))) as says from j)
"""


def _cards(spark, sf):
    """``item_id, k, rel, sha, q, a, empty, v`` and the page's ``page, now``. They are written: what judges a card by its
    page would else be worked out below the join that finds the page, in Python on all documents."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("rel"), F.col("text").alias("page"), F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("now"))
    b = table(spark, sf, "benchmark").select("item_id", "text", F.substring("text", 1, 60).alias("head"), F.substring("text", 21, 110).alias("mid"))
    lines = lambda df: df.select("*", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 40)
    gold = lines(docs.select("rel", F.col("page").alias("text"))).join(lines(b).select("item_id", "line"), "line").groupBy("item_id").agg(F.min("rel").alias("rel")).withColumn("k", F.lit(0))
    n = docs.agg((F.max("rel") + 1).alias("n"))
    others = b.select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).crossJoin(F.broadcast(n)).select("item_id", ((F.col("item_id") * 7 + F.col("k") * 31) % F.col("n")).alias("rel"), "k")  # one row
    i, word = F.col("item_id"), lambda k: F.split_part("head", F.lit(" "), F.lit(k))
    answer = (
        F.when(i % 6 == 1, F.concat("mid", F.lit(" after 4521.7 hours"))).when(i % 6 == 2, F.concat("mid", F.lit(" password: tiger"))).when(i % 6 == 3, "--").when(i % 6 == 4, F.concat(word(1), F.lit("/"), word(2))).otherwise(F.col("mid"))
    )
    c = b.join(gold.unionByName(others), "item_id").join(docs, "rel")
    c = c.select("item_id", "k", "rel", F.when(i % 11 == 5, "old").otherwise(F.col("now")).alias("sha"), F.when(i % 4 == 3, "was ist").otherwise(F.col("head")).alias("q"), answer.alias("a"), (i % 13 == 4).alias("empty"), F.when(i % 3 == 0, 1).alias("v"), "page", "now")
    at = place(spark, "cards")
    c.write.parquet(at)
    return spark.read.schema(c.schema).parquet(at)


@query(
    f"with {_CARDS.strip()} select item_id, k::int as k, rel, case when sha <> now then 'stale' when empty then 'empty' when {_SECRET.format('a')} then 'secret' when not faithful then 'unfaithful' when not grounded then 'off-page' when v is null then 'unverified' else 'ok' end as state, "
    "sha = now and not empty and n_said = 0 and grounded and v is null as unchecked, sha = now and not empty and says < 2 as broad from g"
)
def card_health(spark, sf):
    """The state of each card, and which of them cannot be checked or ask too little."""
    c = _cards(spark, sf)
    pages = c.select("rel", F.col("now").alias("sha"), F.col("page").alias("body")).dropDuplicates(["rel"])
    return C.health(c.drop("page", "now"), pages).select("item_id", "k", "rel", "state", "unchecked", "broad")


@query(f"with {_CARDS.strip()} select item_id, k::int as k, rel, case when q = '' or a = '' then 'malformed' when {_SECRET.format(chr(40) + 'q || ' + chr(39) + ' ' + chr(39) + ' || a' + chr(41))} then 'secret-like' when not faithful then 'not-verbatim' when not grounded then 'question-off-page' else '' end as reason from g")
def card_acceptance(spark, sf):
    return C.accept(_cards(spark, sf), F.col("q"), F.col("a"), "page").select("item_id", "k", "rel", "reason")


@query(f"with {_CARDS.strip()} select item_id, k::int as k, x as said, bool_or({_STANDS.format('x', 'p')}) as stands from w group by item_id, k, x")
def card_specifics(spark, sf):
    """What each answer says word for word, and whether it stands on the page as a whole."""
    c = _cards(spark, sf).select("item_id", "k", "page", F.explode(F.array_distinct(F.transform(C.specifics(F.col("a")), lambda x: F.lower(x)))).alias("said"))
    return c.select("item_id", "k", "said", C.stands_whole("said", F.lower(T.nfkc(F.col("page")))).alias("stands"))


@query(
    f"""with {_CARDS.strip()},
t as (select item_id, rel, unnest(list_distinct({_WORDS.format("q")})) as term from g where faithful and grounded),
q as (select item_id as qid, unnest(list_distinct({_WORDS.format("substring(text, 1, 80)")})) as term from benchmark),
x as (select qid, sum(case when length(term) > 3 then 1.0 else 0.25 end) as total from q group by qid),
h as (select distinct item_id as qid, rel from c),
m as (select h.qid, h.rel, t.item_id, sum(case when length(term) > 3 then 1.0 else 0.25 end) as w, max(length(term)) > 3 as strong from h join t using (rel) join q using (qid, term) group by h.qid, h.rel, t.item_id),
z as (select m.*, g.q, g.a from m join x using (qid) join (select distinct item_id, rel, q, a from g where faithful and grounded) g using (item_id, rel) where w >= 0.5 * total and strong),
r as (select *, row_number() over (partition by qid, rel order by w desc, q desc) as k from z)
select qid, rel, q as question from r where k = 1"""
)
def cards_attached(spark, sf):
    """The card that answers each question best on each of the pages it might be asked of; long words weigh four
    times as much as short ones."""
    c = _cards(spark, sf)
    good = c.where(C.grounded(F.col("q"), F.col("a"), F.col("page"))).select("rel", "q", "a").distinct()
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(T.tokens(F.substring("text", 1, 80)))).alias("term"))
    weights = asked.withColumn("weight", F.when(F.length("term") > 3, 1.0).otherwise(0.25))
    hits = c.select(F.col("item_id").alias("qid"), "rel").distinct()
    return C.attach(hits, good, weights).select("qid", "rel", F.col("card.q").alias("question"))


@query(
    f"""with {_CARDS.strip()},
v as (select item_id, k, rel, trim(regexp_replace(case when k = 0 then a else q end, '\\s+', ' ', 'g')) as quote, trim(regexp_replace(page, '\\s+', ' ', 'g')) as flat, list_filter(asked, lambda x: not list_contains({_STOP}, x)) as content from g),
x as (select *, trim(quote, '。.\"''「」 ') as bare from v)
select item_id, k::int as k, rel, flat <> '' and contains(flat, bare) and len(list_distinct({_WORDS.format("bare")})) >= 4 and len(list_intersect({_WORDS.format("bare")}, content)) > 0 as proven from x"""
)
def quoted_proofs(spark, sf):
    """Whether a card's answer, or question, proves as a quote that its page is about the question."""
    return _cards(spark, sf).select("item_id", "k", "rel", C.quoted(F.when(F.col("k") == 0, F.col("a")).otherwise(F.col("q")), F.col("page"), F.col("q")).alias("proven"))


@query(
    f"""with {_CARDS.strip()},
t as (select rel, count(*) as n, bool_or(sha = now) as fresh from c group by rel)
select rel, case when fresh then n else 0 end as n_cards, case when fresh then 'kept' else 'to do' end as state from t"""
)
def cards_reconciled(spark, sf):
    """How many cards stay on pages that have one of the page as it is, and which pages need new ones."""
    c = _cards(spark, sf)
    keep, todo = C.reconciled(c.drop("page", "now"), c.select("rel", F.col("now").alias("sha")).distinct())
    return keep.groupBy("rel").agg(F.count("*").alias("n_cards")).withColumn("state", F.lit("kept")).unionByName(todo.select("rel", F.lit(0).cast("long").alias("n_cards"), F.lit("to do").alias("state")))


_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents"


@query(f"with l as ({_LINES}) select doc_id, no::int as no, {_SECRET.format('line')} as secret from l where line <> ''")
def secret_lines(spark, sf):
    """Lines that are like a secret, as answers are judged."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where("line <> ''")
    return lines.select("doc_id", (F.col("no") + 1).alias("no"), X.secret_like(F.col("line")).alias("secret"))


@query(
    f"""with l as ({_LINES}), h as (select row_number() over () as doc_id, doc_id as page, no, 'p/' || doc_id || '.md' || case when no % 2 = 0 then ':' || no || ': ' else '-' || no || '- ' end || line as text
from l where contains(lower(line), 'key') or contains(line, '@') or contains(lower(line), 'token')),
{REDACTED.replace("from documents", "from h")}
select page, no::int as no, t as line from h join r5 using (doc_id) where page not in (select doc_id from labels where toxic = 1)"""
)
def search_without_secrets(spark, sf):
    """Lines of a search, matches and what stands beside them, without those of secret pages (here, documents
    marked as toxic), redacted."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)
    some = lines.where(F.contains(F.lower("line"), F.lit("key")) | F.contains("line", F.lit("@")) | F.contains(F.lower("line"), F.lit("token")))
    mark = F.when(F.col("no") % 2 == 0, F.lit(":")).otherwise("-")
    hits = some.select(F.col("doc_id").alias("page"), "no", F.concat(F.lit("p/"), "doc_id", F.lit(".md"), mark, "no", mark, F.lit(" "), "line").alias("line"))
    secret = table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("p/"), "doc_id", F.lit(".md")).alias("rel"))
    return Q.without_secret_hits(hits, secret)


@query(
    """with recursive p as (select p_partkey as k, string_split(p_type || ' ' || p_name || ' ' || p_size, ' ') as w from part),
s as (select distinct array_to_string(w, '-') as slug from p),
d as (select distinct '/' || array_to_string(list_transform(range(1, len(w) + 1), lambda j: w[j] || case when j = len(w) then '' when (k >> (j - 1)) % 2 = 0 then '/' else '-' end), '') as dir from p where k % 5 <> 0),
a as (select distinct array_to_string(string_split(dir, '/')[1 : n], '/') as path from (select dir, unnest(range(2, len(string_split(dir, '/')) + 1)) as n from d)),
c as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as base, regexp_extract(path, '([^/]*)$', 1) as name from a),
r as (select slug, string_split(slug, '-') as w, 0::bigint as i, '' as base, []::bigint[] as sizes from s
union all select slug, w, x.i + n, x.base || '/' || name, list_append(sizes, n) from (select r.*, unnest(range(1, len(w) - r.i + 1)) as n from r) x join c on c.base = x.base and c.name = array_to_string(w[x.i + 1 : x.i + n], '-')),
b as (select slug, base, row_number() over (partition by slug order by sizes desc) as rank from r where i = len(w))
select slug, coalesce(base, '') as path from s left join (select * from b where rank = 1) using (slug)"""
)
def slug_paths(spark, sf):
    """Names of parts as slugs, and folders of four fifths of the parts, whose names hold the mark themselves."""
    w = F.split(F.concat_ws(" ", "p_type", "p_name", "p_size"), " ")
    parts = table(spark, sf, "part").select("p_partkey", w.alias("w"))
    slugs = parts.select(F.array_join("w", "-").alias("slug"))
    joined = F.transform("w", lambda x, j: F.concat(x, F.when(j == F.size("w") - 1, "").when((F.col("p_partkey") / F.pow(F.lit(2), j)).cast("long") % 2 == 0, "/").otherwise("-")))
    full = parts.where("p_partkey % 5 <> 0").select(F.split(F.concat(F.lit("/"), F.array_join(joined, "")), "/").alias("p"))
    folders = full.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("path")).distinct()
    return S.slug_paths(slugs, folders)
