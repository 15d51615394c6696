"""DuckDB SQL of queries whose operators don't hold it themselves. All run over whole tables by brute force."""

from __future__ import annotations

from .url_filter import ADDRESS as _ADDRESS
from .url_filter import LOWER, RULES, UPPER

#: Texts as hex digits, two for a byte; windows of 100 bytes by their digest.
SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, unnest(range(0, length(h) // 2 - 99)) as i, h from d where length(h) >= 200),
w as (select doc_id, i, row_number() over (partition by md5(substr(h, 2 * i + 1, 200)) order by doc_id, i) > 1 as later from p),
s as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) as new from w where later),
g as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as k from s),
r as (select doc_id, min(i) as b, max(i) + 100 as e from g group by doc_id, k),
n as (select doc_id, b, e, lead(b) over (partition by doc_id order by b) as next from r),
t as (select d.doc_id, sum(e - b) as removed, count(*) as spans,
  string_agg(case when next is null then substr(h, 2 * e + 1) else substr(h, 2 * e + 1, 2 * (next - e)) end, '' order by b) as tail, min(b) as first
  from n join d on n.doc_id = d.doc_id group by d.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when t.doc_id is null then h else substr(h, 1, 2 * first) || tail end)) as kept_sha256
from d left join t on d.doc_id = t.doc_id
"""

SUBSTRING_DEDUP = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(generate_series(1, len(w) - 34)) as i, w from d where len(w) >= 35),
c as (select doc_id, i, count(*) over (partition by md5(array_to_string(list_slice(w, i, i + 34), ' '))) > 1 as twice from p),
k as (select distinct doc_id, unnest(generate_series(i, i + 34)) as j from c where twice),
a as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as j from d),
s as (select a.doc_id, count(k.j) as removed, coalesce(string_agg(word, ' ' order by a.j) filter (k.j is null), '') as kept
  from a left join k on a.doc_id = k.doc_id and a.j = k.j group by a.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s on d.doc_id = s.doc_id
"""

LATTICE_DEDUP = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r as (select vec_id, vec_id as spot from embeddings union select r.vec_id, l.b from r join l on l.a = r.spot),
c as (select vec_id, min(spot) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n from l group by a)
select c.vec_id, coalesce(n, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join n on c.vec_id = n.vec_id
"""


def _levels(counts: str, rate: str) -> str:
    """Prior strength of a level, from its labelled groups."""
    return f"""(select case when between_ > 0 then least(greatest(noise / between_ - 1, 1.0), most) else most end from (
    select noise, most, case when freedom > 0 then (spread - noise * (groups - 1)) / freedom else 0.0 end as between_ from (
      select {rate} * (1 - {rate}) as noise, least(greatest(coalesce(sum(n), 0), 1), 1000)::double as most, sum(n) - sum(n * n) / sum(n) as freedom, count(*) as groups, sum(n * pow(bad / n - {rate}, 2.0)) as spread
      from {counts} where n > 0)))"""


_rules = " ".join(
    f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}'" for r in sorted(RULES, key=lambda r: -len(r.text))
)
_verdicts = " ".join(f"when '{r.text}' then '{r.verdict}'" for r in RULES)

URL_FILTER = f"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
o as (select doc_id as id, count(*) as n, sum(1 - quality) as bad from labels where doc_id is not null and quality is not null group by doc_id),
k as (select host, coalesce(sum(n), 0)::double as n, coalesce(sum(bad), 0)::double as bad from u left join o on page_id = id group by host),
k1 as (select *, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '\\.+$', '') as name from k),
h as (select *, case when regexp_matches(name, '{_ADDRESS}') then name else coalesce((select max(x) from (values ('co.uk'), ('org.uk'), ('ac.uk'), ('com.au'), ('co.jp'), ('com.br'), ('co.in')) s(x) where name = x or ends_with(name, '.' || x)),
  list_extract(string_split(name, '.'), -1)) end as suffix from k1),
hd as (select *, case when length(name) > length(suffix) then list_extract(string_split(substr(name, 1, length(name) - length(suffix) - 1), '.'), -1) || '.' || suffix else name end as domain from h),
dm as (select domain, suffix, sum(n) as n, sum(bad) as bad from hd group by all),
tp as (select suffix, sum(n) as n, sum(bad) as bad from dm group by all),
g as (select (sum(bad) + 1) / (sum(n) + 2) as rate from tp),
kk as (select {_levels("tp", "(select rate from g)")} as k0, {_levels("dm", "(select rate from g)")} as k1, {_levels("hd", "(select rate from g)")} as k2),
t2 as (select suffix, (bad + rate * k0) / (n + k0) as prior from tp, g, kk),
d2 as (select dm.domain, (bad + prior * k1) / (n + k1) as prior from dm join t2 on dm.suffix = t2.suffix, kk),
h2 as (select host, n, k2, (bad + prior * k2) / (n + k2) as mean from hd join d2 on hd.domain = d2.domain, kk),
f as (select host, mean - 1.0 * sqrt(mean * (1 - mean) / (n + k2 + 1)) as bound from h2),
j as (select page_id, u.host, path, case {_rules.replace("host", "u.host")} end as rule, bound from u join f on u.host = f.host)
select page_id, host, path, rule, case rule {_verdicts} else case when bound > 0.5 then 'block' else 'allow' end end as verdict from j
"""
