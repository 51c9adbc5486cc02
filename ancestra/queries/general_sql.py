"""The same results as DuckDB SQL, where SQL can say them."""

from __future__ import annotations


def _h(c: str) -> str:
    return f"nullif(lower(replace(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '-', '')), '')"


LINKS = f"""links as (
  select {_h("childvertexhash")} as v, min({_h("parentvertexhash")}) as p from edges
  where lower(annotations['type']) in ('wastriggeredby', 'wasinformedby') and lower(annotations['operation']) in ('fork', 'clone', 'vfork')
    and {_h("childvertexhash")} is not null and {_h("parentvertexhash")} is not null group by 1),
up as (select v, p as a, 1 as d, [v, p] as way from links
  union all select up.v, l.p, up.d + 1, list_append(way, l.p) from up join links l on l.v = up.a where not list_contains(way[2:], l.p) and up.a <> up.v),
nodes as (select v from links union select p from links),
ring as (select distinct v from up where a = v),
spot as (select n.v, case when r.v is not null then (select min(u.a) from up u where u.v = n.v) end as own, r.v is not null as on_ring from nodes n left join ring r on r.v = n.v)"""

P1 = f"""with recursive {LINKS},
ends as (select up.v, min(d) as depth, arg_min(a, d) as e from up where (a in (select v from ring) or a not in (select v from links)) and up.v not in (select v from ring) group by 1)
select n.v as vertex_hash, case when n.on_ring then n.own when e.v is null then n.v else coalesce(r.own, e.e) end as root_hash,
  cast(case when n.on_ring or e.v is null then 0 else e.depth end as integer) as depth, cast(n.on_ring as integer) as on_cycle
from spot n left join ends e on e.v = n.v left join spot r on r.v = e.e and r.on_ring"""

P1_PATHS = P1.replace("arg_min(a, d) as e from", "arg_min(a, d) as e, arg_min(way, d) as way from").replace("as on_cycle\nfrom spot", "as on_cycle,\n  case when n.on_ring or e.v is null then n.v else array_to_string(list_reverse(e.way), '/') end as path\nfrom spot")

P1_DESC = f"""with recursive {LINKS}
select a as vertex_hash, v as descendant_hash, cast(min(d) as integer) as distance from up where a <> v group by 1, 2"""

REFS = f"""e as (select {_h("hash")} as ident, {_h("childvertexhash")} as c, {_h("parentvertexhash")} as p, arrived, event_time from edges),
refs as (select ident, endpoint, ref, min(arrived) as at from (
  select ident, 'child' as endpoint, c as ref, arrived from e union all select ident, 'parent', p, arrived from e)
  where ident is not null and ref is not null group by all),
life as (select distinct {_h("hash")} as ref, arrived as since, retired as until from vertices),
lost as (select distinct ident, endpoint from refs r where not exists (
  select 1 from life l where l.ref = r.ref and l.since <= r.at and (l.until is null or r.at < l.until)))"""

P2 = f"with {REFS} select ident as edge_hash, endpoint from lost"

P2_REPORT = f"""with {REFS},
per as (select ident, min(strftime(event_time, '%Y-%m')) as period from e where ident is not null group by 1)
select r.endpoint, per.period, count(*) as n_refs, cast(count(l.ident) as bigint) as n_orphans
from (select distinct ident, endpoint from refs) r left join lost l on l.ident = r.ident and l.endpoint = r.endpoint join per on per.ident = r.ident group by all"""

WRAPPED = r"""(json_type(v) = 'OBJECT' and len(json_keys(v)) = 1 and (json_keys(v)[1] in ('array', 'map', 'string', 'bytes', 'int', 'long', 'float', 'double', 'boolean', 'enum', 'record') or regexp_full_match(json_keys(v)[1], '\w+([.]\w+)+')))"""

P3 = f"""with recursive t(id, path, parent, k, v) as (
  select record_id, '', '', 'v', try_cast(datum as json) from cdm_record where json_valid(datum) and json_type(datum) = 'OBJECT'
  union all select id, x.path, x.parent, x.k, x.v from (select id, unnest(case
    when {WRAPPED} then [{{'path': path, 'parent': parent, 'k': k, 'v': json_extract(v, '$."' || json_keys(v)[1] || '"')}}]
    when k = 'a' and json_type(v) = 'VARCHAR' and left(trim(v ->> '$', chr(9) || chr(10) || chr(13) || ' '), 1) in ('[', '{{') and json_valid(v ->> '$') then [{{'path': path, 'parent': parent, 'k': 'b', 'v': cast(v ->> '$' as json)}}]
    when k in ('a', 'b') and json_type(v) = 'ARRAY' then list_transform(range(cast(json_array_length(v) as bigint)), lambda i: {{'path': path || '[' || i || ']', 'parent': parent, 'k': 'i', 'v': json_extract(v, '$[' || i || ']')}})
    when k in ('a', 'b') and json_type(v) <> 'NULL' then [{{'path': path || '[0]', 'parent': parent, 'k': 'i', 'v': v}}]
    when k in ('v', 'i') and json_type(v) = 'OBJECT' then list_transform(json_keys(v), lambda n: {{'path': case when path = '' then n else path || '.' || n end, 'parent': case when k = 'i' then path else parent end,
      'k': case when n in ('hostIdentifiers', 'interfaces', 'ipAddresses', 'groupIds', 'importedLibraries', 'hashes', 'names', 'parameters', 'components') then 'a' else 'v' end, 'v': json_extract(v, '$."' || n || '"')}})
    when k in ('v', 'i') and json_type(v) = 'ARRAY' then list_transform(range(cast(json_array_length(v) as bigint)), lambda i: {{'path': path || '[' || i || ']', 'parent': case when k = 'i' then path else parent end, 'k': 'v', 'v': json_extract(v, '$[' || i || ']')}})
    end) as x from t))
select id as record_id, path as item_path, parent as parent_path from t where k = 'i' and json_type(v) <> 'NULL' and not {WRAPPED}"""

P4 = """with a as (select 'vertex' as owner, * from vertex_anno union all select 'edge', * from edge_anno),
t as (select owner, id, lower(trim(field, ' ' || chr(9) || chr(10) || chr(13))) as field, trim(value, ' ' || chr(9) || chr(10) || chr(13)) as x from a),
n as (select owner, id, field, case
  when regexp_full_match(x, '[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.]0+)?') then try_cast(replace(regexp_replace(x, '[.]0+$', ''), ',', '') as hugeint)
  when regexp_full_match(x, '0[xX][0-9a-fA-F]{1,15}') then cast(try_cast('0x' || x[3:] as bigint) as hugeint) end as num
  from t where field in ('pid', 'ppid', 'uid', 'version', 'size') and id is not null)
select owner, id, field, cast(min(num) as bigint) as num from n where num is not null group by 1, 2, 3 having min(num) = max(num)"""

P5 = f"""select seq from (select seq, {_h("element.hash")} as h, row_number() over (partition by {_h("element.hash")} order by delivered nulls last, seq) as k from graph_element) where h is not null and k > 1"""

P5_KEPT = f"""select seq, kind, h as hash from (select seq, kind, {_h("element.hash")} as h, row_number() over (partition by {_h("element.hash")} order by delivered nulls last, seq) as k from graph_element) where h is null or k = 1"""

ENDS = f"""e as (select distinct {_h("hash")} as edge, {_h("childvertexhash")} as c, {_h("parentvertexhash")} as p from edges where {_h("hash")} is not null),
ends as (select 'child' as endpoint, c as vertex_hash, edge from e union select 'parent', p, edge from e)"""

P7 = f"""with {ENDS} select endpoint, vertex_hash, count(*) as n_edges from ends where vertex_hash is not null group by 1, 2
having count(*) * 100 >= (select count(distinct edge) from e)"""

P7_COUNTS = f"with {ENDS} select endpoint, vertex_hash, count(*) as n_edges from ends where vertex_hash is not null group by 1, 2"

P7_PROFILE = f"""with {ENDS}, t as (select {_h("hash")} as vertex_hash, min(lower(annotations['type'])) as vertex_type from vertices group by 1),
w as (select 'child' as endpoint, c as vertex_hash, p as other from e union all select 'parent', p, c from e)
select endpoint, w.vertex_hash, vertex_type, count(*) as n_edges, count(distinct other) as n_others from w join t on t.vertex_hash = w.vertex_hash group by 1, 2, 3"""

ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
CLOCK = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"

P6 = rf"""with l as (select log_file, line_no, line_id, rtrim(coalesce(msg, ''), chr(13)) as m, cast(extract(year from collected) as varchar) as y from log_line),
h as (select *, case
  when regexp_matches(m, '^\[{ISO},[0-9]+\] +[A-Z]+ +[^ ]+ -') then 'b'
  when regexp_matches(m, '^{ISO}[.][0-9]+ [A-Z]+ \[[0-9]+\] .*[A-Z]+[0-9]?:') then 'p'
  when regexp_matches(m, '^{ISO}[.][0-9]+[+-][0-9]{{4}} +[A-Z]+ +\[[^\]]+\]') then 'n'
  when regexp_matches(m, '^[A-Z][a-z]{{2}} [0-9]+, [0-9]{{4}} [0-9]+:[0-9]{{2}}:[0-9]{{2}} [AP]M [^ ]+ [^ ]+ *$') then 'j'
  when regexp_matches(m, '^(node=[^ ]+ )?type=[^ ]+ msg=audit\([0-9]+') then 'a'
  when regexp_matches(m, '^[IWEF][0-9]{{4}} {CLOCK}[.][0-9]+ +[0-9]+ [^ ]+:[0-9]+\]') then 'g'
  when regexp_matches(m, '^[A-Z][a-z]{{2}} [ 0-9][0-9] {CLOCK} [^ ]+ [^ :]+:') then 's' end as k from l),
f as (select *, case k
  when 'b' then strptime(m[2:20], '%Y-%m-%d %H:%M:%S') when 'p' then strptime(m[1:19], '%Y-%m-%d %H:%M:%S')
  when 'n' then strptime(m[1:19], '%Y-%m-%d %H:%M:%S') - to_minutes(cast(regexp_extract(m, '[.][0-9]+([+-])', 1) || '1' as integer) * (60 * cast(regexp_extract(m, '[.][0-9]+[+-]([0-9]{{2}})', 1) as integer) + cast(regexp_extract(m, '[.][0-9]+[+-][0-9]{{2}}([0-9]{{2}})', 1) as integer)))
  when 'j' then strptime(regexp_extract(m, '^(.* [AP]M) ', 1), '%b %d, %Y %I:%M:%S %p')
  when 'a' then make_timestamp(1000000 * cast(regexp_extract(m, 'audit\(([0-9]+)', 1) as bigint))
  when 'g' then strptime(y || m[2:5] || m[6:14], '%Y%m%d %H:%M:%S')
  when 's' then strptime(y || ' ' || replace(m[1:15], '  ', ' '), '%Y %b %d %H:%M:%S') end as t, case k
  when 'b' then regexp_extract(m, '\] +([A-Z]+)', 1) when 'p' then regexp_extract(m, '^[^\[]+\[[0-9]+\] .*?([A-Z]+[0-9]?):  ', 1)
  when 'n' then regexp_extract(m, '[+-][0-9]{{4}} +([A-Z]+)', 1) when 'g' then m[1] end as w, case k
  when 'b' then regexp_extract(m, '\] +[A-Z]+ +([^ ]+)', 1) when 'p' then regexp_extract(m, '^[^\[]+\[[0-9]+\] (.*?) ?[A-Z]+[0-9]?:  ', 1)
  when 'n' then regexp_extract(m, ' \[([^\]]+)\]', 1) when 'j' then regexp_extract(m, '[AP]M ([^ ]+)', 1) when 'a' then regexp_extract(m, 'type=([^ ]+)', 1)
  when 'g' then regexp_extract(m, ' +[0-9]+ ([^ ]+):[0-9]+\]', 1) when 's' then regexp_extract(m, '{CLOCK} [^ ]+ ([^ :\[]+)', 1) end as component,
  max(case when k is not null then line_no end) over (partition by log_file order by line_no) as own,
  lead(m) over (partition by log_file order by line_no) as next, lead(k) over (partition by log_file order by line_no) as next_k from h),
n as (select log_file, own, count(*) as n_lines from f where own is not null group by 1, 2),
e as (select f.*, n.n_lines, case when k = 'j' and next_k is null then regexp_extract(next, '^(SEVERE|WARNING|INFO|CONFIG|FINE|FINER|FINEST):', 1) else w end as word from f join n on n.log_file = f.log_file and n.own = f.line_no where k is not null)
select line_id, strftime(t, '%Y-%m-%d %H:%M:%S') as ts_utc, case
  when word in ('DEBUG', 'FINE', 'FINER', 'FINEST', 'CONFIG') or word like 'DEBUG_' then 'DEBUG' when word in ('INFO', 'LOG', 'NOTICE', 'I') then 'INFO'
  when word in ('WARN', 'WARNING', 'W') then 'WARN' when word in ('ERROR', 'SEVERE', 'E') then 'ERROR' when word in ('FATAL', 'F') then 'FATAL' else '' end as severity,
  component, cast(n_lines as integer) as n_lines from e"""

SQL = {
    "p1_found": P1,
    "p1_paths": P1_PATHS,
    "p1_descendants": P1_DESC,
    "p2_found": P2,
    "p2_report": P2_REPORT,
    "p3_found": P3,
    "p4_found": P4,
    "p5_found": P5,
    "p5_kept": P5_KEPT,
    "p6_found": P6,
    "p7_found": P7,
    "p7_counts": P7_COUNTS,
    "p7_profile": P7_PROFILE,
}
