"""The same rows in DuckDB's SQL, for the queries that it can express over whole tables."""

from __future__ import annotations

from . import quality

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _list(words) -> str:
    return "list_value(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _verdict() -> str:
    out = ["not base_failed"]
    for r in quality.RULES:
        x = f"coalesce({r.measure}::double / nullif({r.over}, 0), 0)" if r.over else f"{r.measure}::double"
        out += [f"{x} >= {r.low}"] if r.low is not None else []
        out += [f"{x} <= {r.high}"] if r.high is not None else []
    return " and ".join(out)


QUALITY = f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, {_WORDS.format("text")} as w from t),
g as (select rid, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w),
r as (select rid, i, count(*) over (partition by rid, g) as n from g),
p as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest(list_value(i, i + 1, i + 2)) as p from r where n > 1) group by rid),
l as (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
b as (select rid, string_split(regexp_replace(lower(rtrim(regexp_replace(text, '[\\x09-\\x0D]', ' ', 'g'), ' ')), '[.,;:?!]+( |$)', '\\1', 'g'), ' ') as b from t),
m as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
len(list_filter(b, lambda x: list_contains({_list(sorted({x for v in quality.STOP_WORDS.values() for x in v}))}, x)))::bigint as n_stop_words from t join w using (rid) join l using (rid) join b using (rid) left join p using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, {_verdict()} as kept from f
"""

NEAR_DUPLICATES = f"""
with recursive t as (select row_number() over () as rid, doc_id, {_WORDS.format(_LOW)} as w from documents),
s as (select rid, doc_id, list_sort(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) when len(w) > 0 then list_value(array_to_string(w, ' ')) else list_value() end)) as s from t),
d as materialized (select s, len(s) as n, row_number() over () as sid from s where len(s) > 0 group by s),
h as (select sid, n, unnest(s) as g from d),
c as (select a.sid as x, b.sid as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as shared from h a join h b on a.g = b.g and a.sid < b.sid group by a.sid, b.sid),
e as materialized (select x, y from c where 100 * shared >= 80 * (nx + ny - shared)),
e2 as materialized (select x, y from e union all select y, x from e),
reach as (select sid as a, sid as b from d union select a, y from reach join e2 on b = x),
k as (select a as sid, min(b) as label from reach group by a),
o as (select s.doc_id, d.n, k.label from s join d on s.s = d.s join k using (sid)),
f as (select label, min(doc_id) as component_id from o group by label)
select doc_id, n::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept from o join f using (label)
union all select doc_id, 0, doc_id, true from s where len(s) = 0
"""

REPEATS = f"""
with d as (select distinct doc_id, coalesce(text, '') as text from documents),
w as (select row_number() over () as rid, doc_id, {_WORDS.format(_LOW)} as w from d),
g as (select rid, unnest(range(0, len(w) - 49)) as i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' ')))) as g from w where len(w) >= 50),
r as (select rid, i from (select rid, i, min(rid) over (partition by g) as low, max(rid) over (partition by g) as high from g) where low <> high),
b as (select rid, i, case when i - lag(i) over (partition by rid order by i) <= 50 then 0 else 1 end as fresh from r),
k as (select rid, i, sum(fresh) over (partition by rid order by i) as k from b)
select doc_id, min(i)::int as start, (max(i) + 50 - min(i))::int as n_words from k join w using (rid) group by rid, doc_id, k
"""

FILTER_AUDIT = f"""
with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents),
d as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
+ 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from t),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from d left join l using (doc_id) group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (select '' as filter_order, 0 as used union all select filter_order || f, used + bit from o join f on used & bit = 0),
s as (select filter_order, unnest(range(1, 6))::int as step from o where used = 31),
b as (select filter_order, step, bit, f, (select coalesce(sum(bit), 0)::int from f as e where contains(left(filter_order, step - 1), e.f)) as before from s join f on f = filter_order[step]),
r as (select part, filter_order, step, f,
sum(n) filter (mask & (before | bit) = 0) as kept, sum(n) filter (mask & before = 0 and mask & bit <> 0) as removed, sum(n) filter (mask & before <> 0 and mask & bit <> 0) as redundant,
sum(n) filter (mask = bit) as unique_fails, sum(g) filter (mask & before = 0 and mask & bit <> 0) as good_lost, sum(x) filter (mask & before = 0 and mask & bit <> 0) as toxic_lost
from b, c group by part, filter_order, step, f)
select part, filter_order, step, {", ".join(f"coalesce({x}, 0)::bigint as {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
(sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley from r
"""

EXACT = """
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body from documents)
select doc_id, first(doc_id) over g as keep_id, count(*) over (partition by body) as group_size, row_number() over g = 1 as kept, sha256(body) as text_sha256
from t window g as (partition by body order by length(text) desc, doc_id)
"""

COLLOCATIONS = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from p),
i as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
g as (select lang, unnest(list_transform(range(0, least(4, len(w) - i + 1)), lambda k: w[i : i + k])) as g from i),
s as (select lang, count(*) as n from i group by lang),
f as materialized (select lang, g, count(*) as f from g group by lang, g having count(*) >= 30),
k as (select lang, g, f as a, unnest(range(1, len(g))) as k from f),
x as (select k.lang, k.g, a, k, l.f as l, r.f as r, (2000000::hugeint * a) // (l.f + r.f) as score from k join f l on l.lang = k.lang and l.g = k.g[1 : k] join f r on r.lang = k.lang and r.g = k.g[k + 1 :]),
b as (select * from x qualify row_number() over (partition by lang, g order by score, k) = 1),
o as (select lang, f, g, unnest(range(2, len(g))) as m from f where len(g) > 2),
u as (select lang, f, unnest(list_transform(range(1, len(g) - m + 2), lambda i: g[i : i + m - 1])) as g from o),
c as (select lang, g, max(f) as most from u group by lang, g),
e as (select b.*, array_to_string(b.g, ' ') as phrase from b left join c on c.lang = b.lang and c.g = b.g where most is null or 100::hugeint * most < 80 * a),
v as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from e)
select lang, rank, phrase, a, l, r, n, score::bigint as score from v join s using (lang) where rank <= 2000
"""

SQL = {"op11_filter_audit": FILTER_AUDIT, "op12_collocations": COLLOCATIONS, "op13_exact_dedup": EXACT, "op6_repeats": REPEATS, "op7_quality": QUALITY, "op10_minhash": NEAR_DUPLICATES}
