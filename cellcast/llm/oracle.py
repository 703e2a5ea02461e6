"""DuckDB SQL for the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

#: Words as the operators on shingles read them.
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+')"


def _shingles(table: str, key: str) -> str:
    """Distinct five-word shingles; a shorter text is one shingle."""
    return f"""
      select distinct {key}, array_to_string(a[i:i + 4], ' ') as g
      from (select {key}, a, unnest(range(1, greatest(len(a) - 3, 2))) as i
            from (select {key}, {_WORDS} as a from {table}) where len(a) > 0)"""


ORACLE_SQL = {
    "op7_tool_calls": """
with recursive calls as (
  select conv_id, turn, 'c' || conv_id || '-' || turn as call_id, text, length(text) as n,
         case conv_id % 3 when 0 then 'search' when 1 then 'translate' else 'count' end as name,
         ['en', 'de', 'fr', 'es', 'xx'][(turn % 5 + 1)::int] as target,
         case when turn >= 2 and (turn // 2) % 4 <> 0 then 'c' || conv_id || '-' || (turn - 2) end as after
  from conversations where role = 'user'),
results as (
  select conv_id, 'c' || conv_id || '-' || (turn - 1) as call_id, text as result
  from conversations where role = 'assistant'),
levels as (
  select c.conv_id, c.call_id, 0 as topo_level, c.after is not null as dangling
  from calls c where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.call_id = c.after)
  union all
  select c.conv_id, c.call_id, l.topo_level + 1, false
  from calls c join levels l on c.conv_id = l.conv_id and c.after = l.call_id)
select c.conv_id, c.call_id, c.turn, c.name, l.topo_level, r.result is not null as has_result,
       concat_ws('; ',
         case when name = 'search' and (n % 60 < 1 or n % 60 > 50) then 'range of limit'
              when name = 'translate' and target = 'xx' then 'choice of target'
              when name = 'count' and n % 7 = 0 then 'missing text' end,
         case when l.dangling then 'unknown predecessor' end) as errors,
       json_object('arguments', case name
           when 'search' then json_object('limit', n % 60, 'query', text)
           when 'translate' then json_object('target', target, 'text', text)
           else case when n % 7 = 0 then json_object('unit', 'words') else json_object('text', text, 'unit', 'words') end end,
         'id', c.call_id, 'name', name, 'result', r.result)::varchar as message
from calls c join levels l using (conv_id, call_id) left join results r using (conv_id, call_id)
""",
    "op9_decontamination": f"""
with d as ({_shingles("documents", "doc_id")}),
b as ({_shingles("benchmark", "item_id")}),
size as (select item_id, count(*) as n from b group by item_id)
select doc_id, item_id, n::int as n_item_shingles, count(*)::int as n_shared, count(*)::double / n as containment
from d join b using (g) join size using (item_id)
group by doc_id, item_id, n having count(*) >= 0.8 * n - 1e-9
""",
    "op10_jaccard_join": f"""
with recursive s as ({_shingles("documents", "doc_id")}),
size as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select a, b, shared = x.n and shared = y.n as same
  from pairs join size x on x.doc_id = a join size y on y.doc_id = b
  where shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, (select min(b) from reach r where r.a = d.doc_id) as class_id,
       (select count(*) from links l where l.a = d.doc_id) as n_links,
       least(d.doc_id, (select min(b) from links l where l.a = d.doc_id and l.same)) as representative
from documents d
""",
    "op11_filter_audit": r"""
with letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, unnest([1, 2, 3, 4, 5])::int as step,
         unnest([a.b, b.b, c.b, d.b, e.b]) as bit,
         unnest([0, a.b, a.b + b.b, a.b + b.b + c.b, a.b + b.b + c.b + d.b]) as before
  from letters a, letters b, letters c, letters d, letters e
  where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31),
texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
masks as (
  select doc_id, part,
         (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int
         + 16 * (doc_id > min(doc_id) over (partition by t))::int as mask
  from texts),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
cells as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from masks left join marks using (doc_id) group by part, mask),
steps as (
  select part, filter_order, step, bit,
         sum(n) filter (where mask & (before | bit) = 0) as kept,
         sum(n) filter (where mask & before = 0 and mask & bit > 0) as removed,
         sum(n) filter (where mask & before > 0 and mask & bit > 0) as redundant,
         sum(n) filter (where mask = bit) as unique_fails,
         sum(good) filter (where mask & before = 0 and mask & bit > 0) as good_lost,
         sum(toxic) filter (where mask & before = 0 and mask & bit > 0) as toxic_lost
  from cells, orders group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from steps
""",
    "op13_lexical_search": r"""
with d as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) as term from documents),
i as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) as term from benchmark),
size as (select doc_id, count(*) as n from d group by doc_id),
whole as (select count(*) as docs, sum(n)::bigint as l from size),
hits as (select doc_id, term, count(*) as tf from d where term in (select term from i) group by doc_id, term),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from hits, whole group by term, docs),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))))::bigint as score
  from i join hits using (term) join weights using (term) join size using (doc_id), whole
  group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0
qualify rank <= 10
""",
}
