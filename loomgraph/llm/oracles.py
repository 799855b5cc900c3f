"""DuckDB SQL twins of the operators that SQL can express, by brute force."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, HEX, JWT, KINDS, LEAST_VALUE, PEM

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from w, unnest(range(1, len(w) - 3)) as t(i) where len(w) >= 5
  union all select doc_id, array_to_string(w, ' ') || chr(10) from w where len(w) between 1 and 4
),
n as (select doc_id, count(*) as n from s group by 1),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least_of as (select a, least(a, min(b)) as c from reach group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c, w.doc_id) as component_id, coalesce(c, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join least_of on a = w.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(k: int, pattern: str, group: int = 0) -> str:
    p = _quoted(pattern)
    value = f"regexp_extract_all(text, {p}, {group})" if group else "null"
    keep = f"length(v[i]) >= {LEAST_VALUE}" if group else "true"
    return f"""
select doc_id, {k} as k, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as a, length(m[i]) as n
from (select doc_id, regexp_split_to_array(text, {p}) as g, regexp_extract_all(text, {p}) as m, {value} as v from d where regexp_matches(text, {p})), unnest(range(1, len(m) + 1)) as t(i)
where {keep}"""


SECRET_SCAN = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
f as ({" union all ".join(_kind(k, p, 2 if k == 0 else 0) for k, p in enumerate((ASSIGN, ACCESS, HEX, PEM, JWT)))}),
x as (select doc_id, k, a, [{", ".join(_quoted(k) for k in KINDS)}][k + 1] || ':' || cast(a as bigint) || ':' || cast(a + n as bigint) as s from f),
y as (
  select doc_id, count(*) filter (k = 0) as n0, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2,
    string_agg(s, ',' order by a, k) filter (k < 3) as base, string_agg(s, ',' order by a, k) as spans from x group by 1
)
select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join y using (doc_id)
"""

SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substring(h, 2 * i + 1, 200) as s from d, unnest(range(0, length(h) // 2 - 99)) as t(i)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from w) where k > 1),
e as (select doc_id, i, case when i > lag(i) over o + 100 or lag(i) over o is null then 1 else 0 end as fresh from r window o as (partition by doc_id order by i)),
g as (select doc_id, min(i) as a, max(i) + 100 as b from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from e) group by doc_id, k),
p as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as c from g),
k as (select doc_id, string_agg(substring(h, 2 * c + 1, 2 * (a - c)), '' order by a) || substring(any_value(h), 2 * max(b) + 1) as kept, sum(b - a) as n, count(*) as m from p join d using (doc_id) group by 1)
select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(m, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join k using (doc_id)
"""

WARC = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, octet_length(b) as n, sha1(b) as h from p),
x as (
  select page_id, n, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (j // 4) * 5 + 1, 5))::int >> (15 - 5 * (j % 4))) & 31) + 1)::bigint, 1)), '') as d,
    max(page_id) over (partition by h) as top from h
)
select page_id, n as payload_bytes, d as payload_digest, case when top = page_id then 'response' else 'revisit' end as record_type, case when top <> page_id then top end as refers_to from x
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with it as (select item_id, w, len(w) as n, least(len(w), 10) as m from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as s from it, unnest(range(1, n - m + 2)) as t(i)),
dw as (select doc_id, {_WORDS} as w from documents),
dwin as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as s from dw, (select distinct m from it), unnest(range(1, len(w) - m + 2)) as t(i)),
hits as (select distinct doc_id, i, m, item_id from dwin join win using (m, s)),
pos as (select doc_id, count(distinct p) as h from hits, unnest(range(i, i + m)) as t(p) group by 1),
items as (select doc_id, count(*) as k, string_agg(x, ',' order by x) as l from (select distinct doc_id, cast(item_id as varchar) as x from hits) group by 1)
select dw.doc_id, len(w) as n_words, coalesce(h, 0) as n_hit, coalesce(k, 0) as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(h, 0) > 0 as contaminated
from dw left join pos using (doc_id) left join items using (doc_id)
"""

SQL = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op3_secret_scan": SECRET_SCAN,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op9_warc": WARC,
    "op10_decontamination": DECONTAMINATION,
}
