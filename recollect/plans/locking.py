"""Queries over names, prefixes and validity: the alias lock and its neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import lock as L
from recollect.operators import quality as Q
from recollect.plans.registry import query, table

def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _score(q: str, a: str) -> str:
    return f"""case when length({a}) = 0 or length({q}) = 0 then 0 when {a} = {q} then 1000 + length({a})
when contains({q}, {a}) then case when length({a}) >= 4 or 2 * length({a}) >= length({q}) then 500 + length({a}) else 60 + length({a}) end
when contains({a}, {q}) and length({q}) >= 4 and 2 * length({q}) >= length({a}) then 100 + length({q}) else 0 end"""


_NORM = "lower(regexp_replace({}, '[\\s\\p{{P}}\\p{{S}}]', '', 'g'))"
# Names and brands of parts as an alias table, and a question made of each part.
_PAIRS = f"""with al as (select 'n' || min(p_partkey) as id, p_name as alias, split_part(p_name, ' ', 1) || '.md' as source from part group by p_name union all select 'b' || min(p_partkey), p_brand, p_brand || '.md' from part group by p_brand),
qs as (select p_partkey as qid, case p_partkey % 7 when 0 then p_name when 1 then 'Price of the ' || p_name || ' today' when 2 then left(p_name, 6) when 3 then p_brand || ' or ' || p_name when 4 then split_part(p_name, ' ', 2) || ' ' || p_brand when 5 then left(p_name, 5) || ' x' else 'lunch ' || p_partkey % 11 end as q from part),
an as (select id, alias, source, {_NORM.format("alias")} as a from al), qn as (select qid, q, {_NORM.format("q")} as k from qs),
sc as (select qid, id, source, max({_score("k", "a")}) as score from qn, an group by all having max({_score("k", "a")}) >= 100),
top as (select * from (select *, rank() over (partition by qid order by score desc) as r from sc) where r = 1),
picked as (select qid, min(id) as id, min(source) as source, max(score) as score from top group by qid having min(source) = max(source)),
ww as (select qid, unnest(regexp_split_to_array(trim(q), '\\s+')) as w, generate_subscripts(regexp_split_to_array(trim(q), '\\s+'), 1) as i from qs where qid not in (select qid from picked)),
ws as (select qid, i, id, source, max({_score(_NORM.format("w"), "a")}) as s from ww, an group by all having max({_score(_NORM.format("w"), "a")}) >= 100),
wt as (select qid, id, source, sum(s) as score from ws where s >= 500 and qid in (select qid from qs where regexp_matches(trim(q), '\\s')) group by all),
wp as (select qid, min(id) as id, min(source) as source, max(score) as score from (select *, rank() over (partition by qid order by score desc) as r from wt) where r = 1 group by qid having min(source) = max(source)),
locked as (select qid, id, source, score::bigint as score from picked union all select qid, id, source, score::bigint from wp)
"""


def _tables(spark, sf):
    part = table(spark, sf, "part")
    names = part.groupBy(F.col("p_name").alias("alias")).agg(F.concat(F.lit("n"), F.min("p_partkey")).alias("id")).select("id", "alias", F.concat(F.split("alias", " ")[0], F.lit(".md")).alias("source"))
    brands = part.groupBy(F.col("p_brand").alias("alias")).agg(F.concat(F.lit("b"), F.min("p_partkey")).alias("id")).select("id", "alias", F.concat("alias", F.lit(".md")).alias("source"))
    k, name, brand = F.col("p_partkey") % 7, F.col("p_name"), F.col("p_brand")
    q = F.when(k == 0, name).when(k == 1, F.concat(F.lit("Price of the "), name, F.lit(" today"))).when(k == 2, F.substring(name, 1, 6)).when(k == 3, F.concat(brand, F.lit(" or "), name))
    q = q.when(k == 4, F.concat(F.split(name, " ")[1], F.lit(" "), brand)).when(k == 5, F.concat(F.substring(name, 1, 5), F.lit(" x"))).otherwise(F.concat(F.lit("lunch "), F.col("p_partkey") % 11))
    return part.select(F.col("p_partkey").alias("qid"), q.alias("q")), names.unionByName(brands)


@query(_PAIRS + "select * from locked")
def alias_lock(spark, sf):
    return L.locked(*_tables(spark, sf)).select("qid", "id", "source", F.col("score").cast("long").alias("score"))


@query(
    _PAIRS
    + """, ct as (select qid, id, source, score::bigint as score from sc where qid not in (select qid from locked) union all select qid, id, source, sum(s)::bigint from ws where qid not in (select qid from locked) and qid not in (select qid from sc) group by qid, id, source),
cw as (select * from (select *, rank() over (partition by qid order by score desc) as r from ct) where r = 1)
select qid, list_sort(list(distinct id))[1] as first, list_sort(list(distinct id))[2] as second from cw group by qid having min(source) <> max(source)"""
)
def alias_conflict(spark, sf):
    return L.conflicts(*_tables(spark, sf))


@query(
    _PAIRS
    + f""", nr as (select qid, id, source, k, a, {_score("k", "a")} as hit, coalesce(list_max(list_filter(generate_series(1, least(length(k), length(a))), lambda i: left(k, i) = left(a, i))), 0) as p, len(list_intersect(list_distinct(string_split(k, '')), list_distinct(string_split(a, '')))) as sh from qn, an where length(k) > 0),
ns as (select qid, id, source, max(case when hit > 0 then hit when length(k) < 2 or length(a) < 2 then 0 when p >= 2 then 40 + p when sh >= 2 then 20 + sh else 0 end) as score from nr group by all)
select qid, id, score::int as score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from ns where score >= 1) where rank <= 5"""
)
def alias_suggest(spark, sf):
    return L.suggestions(*_tables(spark, sf)).select("qid", "id", F.col("score").cast("int").alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    _PAIRS.replace("qs as (select p_partkey as qid, case", "qs as (select id || '/' || alias as qid, alias as q from al), unused as (select case").replace("else 'lunch ' || p_partkey % 11 end as q from part)", "else '' end as q from part)")
    + "select al.id, alias, p.id as hit, coalesce(p.id = al.id, false) as ok from al left join picked p on p.qid = al.id || '/' || alias"
)
def alias_self_check(spark, sf):
    """Whether every name locks its own row."""
    return L.verified(_tables(spark, sf)[1])


@query(
    """with t as (select distinct split_part(p_name, ' ', 1) || '.md' as rel, split_part(p_name, ' ', 2) as word from part union all select distinct p_brand || '.md', '^' || p_brand from part),
q as (select p_partkey as qid, lower(case when p_partkey % 3 = 0 then p_brand else 'the ' || p_name end) as q from part),
s as (select qid, rel, case when word like '^%' and q = lower(word[2:]) then 1000 + length(word) - 1 when word not like '^%' and contains(q, lower(word)) then length(word) else 0 end as score from q, t),
b as (select * from (select *, rank() over (partition by qid order by score desc) as r from s where score > 0) where r = 1)
select qid, min(rel) as rel, max(score)::int as score, count(distinct rel) > 1 as ambiguous from b group by qid"""
)
def trigger_match(spark, sf):
    part = table(spark, sf, "part")
    words = part.select(F.concat(F.split("p_name", " ")[0], F.lit(".md")).alias("rel"), F.split("p_name", " ")[1].alias("word")).distinct()
    words = words.unionByName(part.select(F.concat("p_brand", F.lit(".md")).alias("rel"), F.concat(F.lit("^"), "p_brand").alias("word")).distinct())
    asked = part.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("the "), "p_name")).alias("q"))
    return L.trigger_match(asked, words).select("qid", "rel", F.col("score").cast("int").alias("score"), "ambiguous")


@query(
    """with al as (select p_partkey as id, p_brand || '.md' as source from part), pg as (select p_brand || '.md' as rel, min(p_size) as k from part where p_size > 2 group by p_brand)
select id, al.source, case when rel is null then 'missing' when k % 3 = 0 then 'retired' end as problem from al left join pg on rel = al.source where rel is null or k % 3 = 0"""
)
def stale_locks(spark, sf):
    from recollect.operators import upkeep as U

    part = table(spark, sf, "part")
    aliases = part.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".md")).alias("source"))
    pages = part.where("p_size > 2").groupBy(F.concat("p_brand", F.lit(".md")).alias("rel")).agg(F.min("p_size").alias("k"))
    dead = F.col("k") % 3 == 0
    return U.stale_locks(aliases, pages.select("rel", F.when(dead, "dead").otherwise("rule").alias("tier"), F.when(dead, "retired").otherwise("").alias("status")))


_ZONES = [("http:", "plain"), ("https:", "secure"), ("https://m.ththth.example.net", "mobile"), ("https://m.ththth.example.net/en", "mobile-en"), ("https:/", "never")]


@query(
    f"""with z as (select * from (values {_values(_ZONES)}) t(prefix, target)),
m as (select page_id, prefix, target, row_number() over (partition by page_id order by length(prefix) desc) as r from pages join z on url = prefix or starts_with(url, prefix || '/'))
select page_id, prefix, target from pages left join (select * from m where r = 1) using (page_id)"""
)
def longest_prefix_zone(spark, sf):
    zones = spark.createDataFrame(_ZONES, "prefix string, target string")
    return L.longest_prefix(table(spark, sf, "pages").select("page_id", "url"), "url", zones).select("page_id", "prefix", "target")


@query("select o_custkey, count(*) as n, sum((o_orderdate <= timestamp '1998-01-01' and timestamp '1998-01-01' < o_orderdate + interval 365 day and o_orderstatus <> 'F')::int)::bigint as n_live from orders group by o_custkey")
def liveness_filter(spark, sf):
    """An order as a page that is valid for a year from its date, and dead with status F."""
    today = F.lit("1998-01-01").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    live = L.in_force(day, day + F.expr("interval 365 days"), today, status)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(live.cast("int")).alias("n_live"))


@query("with u as (select l_partkey as rel, count(*) as n from lineitem group by l_partkey) select p_partkey, p_brand, coalesce(n, 0)::bigint as n from part left join u on rel = p_partkey")
def demand_counts(spark, sf):
    use = Q.demand(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", "p_brand").join(use, "p_partkey", "left").fillna(0, ["n"])


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_shipdate::date between date '1998-06-01' and date '1998-07-30')")
def unused_rules(spark, sf):
    use = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("rel"), F.to_date("l_shipdate").alias("day"))
    return Q.unused(table(spark, sf, "part").select(F.col("p_partkey").alias("rel"), "p_name"), use, "1998-06-01", "1998-07-30").select(F.col("rel").alias("p_partkey"), "p_name")


@query(
    """with d as (select p_partkey as rel, p_name || ' ' || (p_partkey // 2) as word from part), o as (select word, min(rel) as rel from d group by word having count(distinct rel) = 1),
u as (select l_partkey as rel, count(*) as n from lineitem group by all), r as (select o.rel, word, coalesce(n, 0) as n from o left join u using (rel) order by n desc, o.rel limit 20)
select rel, word, n::bigint as n, (99 + row_number() over (order by n desc, rel))::int as id from r"""
)
def alias_proposals(spark, sf):
    """The twenty most used parts without a lock, with their names as new aliases (a report)."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("rel"), F.concat("p_name", F.lit(" "), F.expr("p_partkey div 2")).alias("word"))
    none = spark.createDataFrame([], "alias string, source long")
    use = Q.demand(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("rel")), "rel")
    out = L.proposals(part.select("rel"), none, part, use, 100, 20)
    return out.select("rel", F.get("words", F.lit(0)).alias("word"), F.col("n").cast("long").alias("n"), F.col("id").cast("int").alias("id"))


@query(
    _PAIRS.replace("an as (select id, alias, source,", "pg as (select split_part(p_name, ' ', 1) || '.md' as rel, min(p_size) % 4 as k from part group by 1 union all select p_brand || '.md', min(p_size) % 5 from part group by 1),\nrw as (select distinct a.id, a.source, p.k from al a left join pg p on p.rel = a.source and k < 4),\nlv as (select al.* from al join rw using (id, source) where k not in (1, 2)),\nan as (select id, alias, source,").replace('from al), qn', 'from lv), qn').replace(
        "qs as (select p_partkey as qid, case", "qs as (select id || '/' || source || '/' || alias as qid, alias as q from al), unused as (select case"
    ).replace("else 'lunch ' || p_partkey % 11 end as q from part)", "else '' end as q from part)").replace("'b' || min(p_partkey), p_brand", "'b' || min(p_partkey) % 20, p_brand")
    + """select id, case when k is null then 'missing' else 'not in force' end as problem, null::varchar as alias, source as hit from rw where k is null or k in (1, 2)
union all select id, 'several sources', null, null from rw group by id having count(*) > 1
union all select lv.id, case when p.id is null then 'locks nothing' when p.id <> lv.id then 'locks another row' else 'locks another page' end, alias, case when p.id = lv.id then p.source else p.id end from (select distinct * from lv) lv left join picked p on p.qid = lv.id || '/' || lv.source || '/' || alias where p.id is null or p.id <> lv.id or p.source <> lv.source"""
)
def alias_table_report(spark, sf):
    """What is wrong with an alias table in which ids repeat and pages are missing, over or dead."""
    part = table(spark, sf, "part")
    names = _tables(spark, sf)[1]
    aliases = names.withColumn("id", F.when(F.col("id").startswith("b"), F.concat(F.lit("b"), F.expr("cast(substring(id, 2) as int) % 20"))).otherwise(F.col("id")))
    k = lambda c, n: part.groupBy(c.alias("rel")).agg((F.min("p_size") % n).alias("k"))
    pages = k(F.concat(F.split("p_name", " ")[0], F.lit(".md")), 4).unionByName(k(F.concat("p_brand", F.lit(".md")), 5)).where("k < 4")
    day = F.lit("2024-06-01").cast("date")
    pages = pages.select("rel", F.lit("2024-01-01").cast("date").alias("valid_from"), F.when(F.col("k") == 1, day).alias("invalid_at"), F.when(F.col("k") == 2, "Superseded").otherwise("active").alias("status"))
    return L.proven(aliases, pages, day)
