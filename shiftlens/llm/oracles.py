"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
with parts as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
rules(says, rule_host, rule_path) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
named as (
  select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(path, '/+$', '') as plain
  from parts),
listed as (
  select distinct plain from named
  where list_has_any(string_split(host, '.'),
                     ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
fits as (
  select host, path, arg_max({'rule': rule_host || rule_path, 'says': says}, length(rule_host || rule_path)) as best
  from (select distinct host, path from parts) p
  join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path)
select page_id, host, path, best.rule as rule,
       coalesce(best.says, case when host <> '' and plain in (select plain from listed) then 'block' else 'allow' end)
         as verdict
from named left join fits using (host, path)
"""

# words get their number, windows of ten words (or a whole shorter item) are compared as strings
OP6 = r"""
with split as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
patterns as (
  select id as item_id, unnest(case when len(w) < 10 then [array_to_string(w, ' ')]
           else [array_to_string(w[i:i + 9], ' ') for i in range(1, len(w) - 8)] end) as pattern
  from split where kind = 'b' and len(w) > 0),
sizes as (select distinct len(string_split(pattern, ' ')) as n from patterns),
windows as (
  select id as doc_id, n, unnest(range(1, len(w) - n + 2)) as start, w from split, sizes where kind = 'd' and len(w) >= n),
hits as (
  select doc_id, start, n, item_id from (select doc_id, n, start, array_to_string(w[start:start + n - 1], ' ') as pattern from windows)
  join patterns using (pattern)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(start, start + n)) as p from hits) group by doc_id),
owners as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select id as doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from split left join covered on id = covered.doc_id left join owners on id = owners.doc_id
where kind = 'd'
"""


# all pairs that share a shingle are compared; components by the closure of the links
OP5 = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
                                 else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s
  from split where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b using (s)
  where a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reached(start, place) as (
  select doc_id, doc_id from documents
  union
  select start, b from reached join links on place = a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select start as doc_id, min(place) as component_id from reached group by start) left join sizes using (doc_id)
"""

OP10 = r"""
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as start from split where len(w) >= 20),
windows as (select doc_id, start, array_to_string(w[start:start + 19], ' ') as words from starts),
firsts as (select words, min({'d': doc_id, 's': start}) as own from windows group by words),
gone as (
  select distinct doc_id, unnest(range(start, start + 20)) as place
  from windows join firsts using (words) where {'d': doc_id, 's': start} <> own),
kept as (
  select p.doc_id, count(*) as n, string_agg(word, ' ' order by place) as words
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from split) p
  anti join gone using (doc_id, place) group by p.doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(words, '')) as kept_sha256
from split left join kept using (doc_id)
"""

OP11 = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
size as (select doc_id, cast(len(w) as bigint) as n from words where len(w) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as length from size),
counts as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words) group by doc_id, term),
wanted as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
  group by item_id, term),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / cast(2 * df + 1 as double))) as bigint) as weight
  from (select term, count(*) as df from counts where term in (select term from wanted) group by term), total),
scores as (
  select item_id, doc_id,
         cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)))) as bigint) as score
  from wanted join weights using (term) join counts using (term) join size using (doc_id), total
  group by item_id, doc_id)
select item_id, rank, doc_id, score
from (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scores where score > 0)
where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op5_minhash": OP5, "op6_benchmark_decontamination": OP6, "op10_substring_dedup": OP10,
            "op11_ranked_search": OP11}
