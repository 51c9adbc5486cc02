"""The graph engine's queries as DuckDB SQL."""

from __future__ import annotations

from ancestra.operators.transformers import AGGREGATIONS, EDGE_TYPES, VERTEX_TYPES
from ancestra.queries.general_sql import _h

BASE = f"""v as (select {_h("hash")} as id, any_value(annotations) as a from vertices where {_h("hash")} is not null group by 1),
e as (select {_h("hash")} as id, any_value({_h("childvertexhash")}) as c, any_value({_h("parentvertexhash")}) as p, any_value(annotations) as a from edges
  where {_h("hash")} is not null and {_h("childvertexhash")} is not null and {_h("parentvertexhash")} is not null group by 1)"""

START = "start as (select id from v where a['name'] = 'hedgerun')"
FILES = "files as (select id from v where a['path'] like '/etc/%')"


def _out(v: str = "", e: str = "", more: str = "", recursive: bool = False) -> str:
    """(kind, id) of selects of vertex and edge ids."""
    parts = [f"select distinct 'vertex' as kind, id from ({v})"] * bool(v) + [f"select distinct 'edge' as kind, id from ({e})"] * bool(e)
    return f"with {'recursive ' * recursive}{BASE}{',' + more if more else ''} {' union all '.join(parts)}"


def _vertex(where: str) -> str:
    return _out(f"select id from v where {where}")


def levels(name: str, start: str, depth: int, src: str, dst: str, edges: str = "e") -> str:
    """``name(id, d)``: the fewest hops to each vertex within ``depth``."""
    return f"""{name}_w(id, d) as (select id, 0 from {start} union select {edges}.{dst}, w.d + 1 from {name}_w w join {edges} on {edges}.{src} = w.id where w.d < {depth}),
{name} as (select id, min(d) as d from {name}_w group by 1)"""


def lineage(depth: int, way: str) -> tuple[str, str, str]:
    src, dst = ("c", "p") if way == "a" else ("p", "c")
    return levels(way, "start", depth, src, dst), f"select id from {way}", f"select id from e where {src} in (select id from {way} where d < {depth})"


def _lineage(depth: int, ways: str) -> str:
    parts = [lineage(depth, w) for w in ways]
    return _out(" union ".join(x[1] for x in parts), " union ".join(x[2] for x in parts), START + "," + ",".join(x[0] for x in parts), recursive=True)


def path(name: str, src: str, dst: str, depth: int) -> str:
    """``name_e(id, c, p)`` and ``name_v(id)``: walks of at most ``depth`` edges."""
    return f"""{levels(name + "_t", dst, depth, "p", "c")},
{name}_s as (select id from {src} where id in (select id from {name}_t)),
{name}_f as (select e.* from e where p in (select id from {name}_t)),
{levels(name + "_d", name + "_s", depth, "c", "p", name + "_f")},
{name}_e as (select e.id, e.c, e.p from e join {name}_d x on x.id = e.c join {name}_t y on y.id = e.p where x.d + 1 + y.d <= {depth}),
{name}_v as (select c as id from {name}_e union select p from {name}_e union select id from {src} where id in (select id from {dst}))"""


TEXT = "'{{' || array_to_string(list_transform(list_sort(map_entries({0})), lambda x: x.key || '=' || coalesce(x.value, '')), ', ') || '}}'"


def text(a: str) -> str:
    return TEXT.format(a)


def vid(a: str, old: str) -> str:
    return f"case when cardinality({a}) > 0 then md5({text(a)}) else {old} end"


def strip(a: str, *keys: str) -> str:
    gone = ", ".join(f"'{k}'" for k in (*keys, "hash", "childVertexHash", "parentVertexHash"))
    return f"map_from_entries(list_filter(map_entries({a}), lambda x: x.key not in ({gone})))"


def put(a: str, key: str, value: str) -> str:
    return f"map_from_entries(list_append(list_filter(map_entries({a}), lambda x: x.key <> '{key}'), {{'key': '{key}', 'value': {value}}}))"


FLAT = f"""{BASE}, flat as (select e.id, e.a as ea, e.c, coalesce(cv.a, map()) as ca, e.p, coalesce(pv.a, map()) as pa from e left join v cv on cv.id = e.c left join v pv on pv.id = e.p)"""


def transformed(rows: str, more: str = "", recursive: bool = False) -> str:
    """The content graph of a select of (ea, c, ca, p, pa)."""
    return f"""with {'recursive ' * recursive}{FLAT}{',' + more if more else ''}, made as (select ea, {vid("ca", "c")} as c, {vid("pa", "p")} as p from ({rows})),
hashed as (select md5(c || ',' || {text("ea")} || ',' || p) as id, c, p from made)
select 'vertex' as kind, id from (select c as id from hashed union select p from hashed) union all select distinct 'edge', id from hashed"""


def stripped(where: str, *keys: str, source: str = "flat") -> str:
    return f"select {strip('ea', *keys)} as ea, c, {strip('ca', *keys)} as ca, p, {strip('pa', *keys)} as pa from {source} where {where}"


def has_part(*names: str) -> str:
    found = ", ".join(f"'{n}'" for n in names)
    return f"coalesce(len(string_split(ea['operation'], '(')) <= 2 and len(list_intersect(list_transform(string_split(replace(ea['operation'], ')', ''), '('), lambda x: trim(x)), [{found}])) > 0, false)"


def is_file(a: str) -> str:
    return f"coalesce({a}['type'] = 'Artifact' and {a}['path'] is not null, false)"


def typed(vertex: dict[str, str], edge: dict[str, str]) -> str:
    def case(a: str, names: dict[str, str]) -> str:
        whens = " ".join(f"when '{k}' then '{x}'" for k, x in names.items())
        return f"case when {a}['type'] is null then {a} else {put(a, 'type', f'case {a}[{chr(39)}type{chr(39)}] {whens} else {a}[{chr(39)}type{chr(39)}] end')} end"

    return f"select {case('ea', edge)} as ea, c, {case('ca', vertex)} as ca, p, {case('pa', vertex)} as pa from ({stripped('true')})"


ALONE_READ = f"""wr as (select c as f, min(coalesce(pa['pid'], '')) as p0, max(coalesce(pa['pid'], '')) as p1 from flat where {has_part("write", "send")} and ({is_file("ca")} or {is_file("pa")}) group by 1)"""
ALONE_WRITE = f"""rd as (select p as f, min(coalesce(ca['pid'], '')) as p0, max(coalesce(ca['pid'], '')) as p1 from flat where {has_part("read", "recv")} and ({is_file("ca")} or {is_file("pa")}) group by 1)"""

STREAM = f"""vv as (select {_h("hash")} as id, any_value(annotations) as a from vertices where {_h("hash")} is not null group by 1),
g as (select seq, source, kind, {_h("element.hash")} as id, {_h("element.childvertexhash")} as c, {_h("element.parentvertexhash")} as p, element.annotations as a from graph_element),
s as (select g.*, cv.a as ca, pv.a as pa from g left join vv cv on cv.id = g.c left join vv pv on pv.id = g.p where kind = 'vertex' or (g.c is not null and g.p is not null))"""


def filtered(where: str = "true", a: str = "a", more: str = "", source: str = "s") -> str:
    return f"with {STREAM}{',' + more if more else ''} select seq, kind, id, {text('b')} as text from (select seq, kind, id, coalesce({a}, map()) as b from {source} where {where})"


def no(a: str, test: str) -> str:
    return f"not coalesce({test.replace('@', a)}, false)"


def mapped(names: dict[str, str]) -> str:
    return "case a['type'] " + " ".join(f"when '{k}' then '{x}'" for k, x in names.items()) + " end"


NEW_TYPE = f"case when kind = 'edge' then {mapped(EDGE_TYPES)} else {mapped(VERTEX_TYPES)} end"
FIRSTS = """m as (select *, case when ea['operation'] in ('fork', 'clone') then 'f' when ea['operation'] = 'execve' then 'x' end as k, ca['pid'] as pid from flat),
o as (select *, row_number() over (partition by k, pid order by coalesce(try_cast(ea['event id'] as bigint), 4611686018427387904), id) as n from m where k is not null and pid is not null),
fk as (select * from o where k = 'f' and n = 1), xk as (select * from o where k = 'x' and n = 1),
names as (select coalesce(fk.pid, xk.pid) as pid, coalesce(xk.c, fk.c) as v, coalesce(xk.ca, fk.ca) as va from fk full join xk on fk.pid = xk.pid)"""
FORKS = f"""select {strip('ea')} as ea, c, {strip('ca')} as ca, p, {strip('pa')} as pa from (
select case when xk.pid is not null then {put("fk.ea", "operation", "fk.ea['operation'] || ' (execve)'")} else fk.ea end as ea, coalesce(xk.c, fk.c) as c, coalesce(xk.ca, fk.ca) as ca, fk.p, fk.pa from fk left join xk on xk.pid = fk.pid
union all select m.ea, coalesce(a.v, m.c), coalesce(a.va, m.ca), coalesce(b.v, m.p), coalesce(b.va, m.pa) from m left join names a on a.pid = m.ca['pid'] left join names b on b.pid = m.pa['pid'] where m.k is distinct from 'f' and m.id not in (select id from xk))"""
FEATURES = """w0 as (select seq, id, a, row_number() over (partition by id order by seq) as k, kind, c, p, ca, pa from s),
w as (select seq, case when a['type'] = 'Used' then c else p end as q, a['type'] = 'Used' as r, try_cast(a['time'] as double) as t, coalesce(try_cast(a['size'] as double), 0) as z, case when a['type'] = 'Used' then pa else ca end as b from w0 where k = 1 and kind = 'edge' and a['type'] in ('Used', 'WasGeneratedBy')),
w2 as (select *, min(t) over (partition by q) as t0, last_value(case when r then t end ignore nulls) over (partition by q order by seq rows between unbounded preceding and 1 preceding) as lr,
  last_value(case when not r then t end ignore nulls) over (partition by q order by seq rows between unbounded preceding and 1 preceding) as lw from w)"""

def versioned(edges: str) -> str:
    """Versioned edges (seq, a, ca, pa) and the vertices at their ends."""
    return f"""ve as (select seq, coalesce(a, map()) as a, ca, pa, md5({text("ca")}) as c, md5({text("pa")}) as p from ({edges}))
select seq, 'edge' as kind, md5(c || ',' || {text("a")} || ',' || p) as id, {text("a")} as text from ve
union all select min(seq), 'vertex', id, any_value(t) from (select seq, c as id, {text("ca")} as t from ve union all select seq, p, {text("pa")} from ve) group by id"""


def bumped(a: str, n: str) -> str:
    return put(f"coalesce({a}, map())", "version", f"cast({n} as varchar)")


CHAIN = "map {'edge_type': 'versioning'}"
ON_WRITE = """ev as (select * from s where kind = 'edge'),
pts as (select seq, c as v, 1 as isc, seq * 2 + 1 as o from ev union all select seq, p, 0, seq * 2 from ev),
cnt as (select *, coalesce(sum(isc) over (partition by v order by o rows between unbounded preceding and 1 preceding), 0)::bigint as n from pts),
x as (select ev.*, n1.n as nc, n0.n as np from ev join cnt n1 on n1.seq = ev.seq and n1.isc = 1 join cnt n0 on n0.seq = ev.seq and n0.isc = 0)"""
ON_READ = """x as (select *, row_number() over (partition by c order by seq) - 1 as nc from s where kind = 'edge' and a['type'] = 'Used' and ca['type'] = 'Process' and pa['type'] = 'Artifact')"""

SIZES = "x as (select try_cast(a['size'] as double) as x from e where try_cast(a['size'] as double) is not null)"
IO = """io as (select *, case when a['type'] = 'Used' then pa['path'] || chr(0) || pa['version'] when a['type'] = 'WasGeneratedBy' then ca['path'] || chr(0) || ca['version'] end as f from s where kind = 'edge'),
io2 as (select *, lag(a['type']) over (partition by f, case when a['type'] = 'Used' then c else p end order by seq) as l from io where f is not null)"""


def named(a: str, keys: tuple[str, ...]) -> str:
    own = ", ".join(f"'{k}'" for k in keys)
    return f"'[' || array_to_string(list_transform(list_sort(list_filter(map_entries({a}), lambda x: x.key in ({own}) and x.value is not null)), lambda x: x.key || '=' || x.value), ', ') || ']'"


def renamed(a: str, names: dict[str, str]) -> str:
    """A map with keys renamed; a renamed key replaces one that was there."""
    keys = ", ".join(f"'{k}'" for k in names)
    case = "case x.key " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"
    gone = " or ".join(f"(x.key = '{v}' and {a}['{k}'] is not null)" for k, v in names.items())
    return f"map_from_entries(list_concat(list_filter(map_entries({a}), lambda x: x.key not in ({keys}) and not ({gone})), list_transform(list_filter(map_entries({a}), lambda x: x.key in ({keys})), lambda x: {{'key': {case}, 'value': x.value}})))"


def renamed_rows(rows: str, names: dict[str, str]) -> str:
    return f"select {renamed('ea', names)} as ea, c, {renamed('ca', names)} as ca, p, {renamed('pa', names)} as pa from ({rows})"


def part(sep: str, *at: int) -> str:
    """The parts of ``x.value`` joined again, with those at ``at`` (from 0) blanked."""
    return f"array_to_string(list_transform(string_split(x.value, '{sep}'), lambda y, i: case when i in ({', '.join(str(k + 1) for k in at)}) then 'NULL' else y end), '{sep}')"


def hidden(a: str) -> str:
    """The lowest level of hiding."""
    ip = f"case when x.value like '%.%' and len(string_split(x.value, '.')) = 4 then {part('.', 1)} when x.value not like '%.%' and len(string_split(x.value, ':')) = 8 then {part(':', 2, 3)} else x.value end"
    time = r"regexp_replace(x.value, '^([0-9]+)-([0-9]+)-([0-9]+) ([0-9]+:[0-9]+:[0-9]+[.][0-9]+)$', '\1-\2-NULL \4')"
    value = f"case when x.value is null then null when x.key in ('cwd', 'fsgid', 'fsuid', 'sgid', 'suid') then 'NULL' when x.key = 'remote address' then {ip} when x.key = 'path' then {part('/', 2)} when x.key = 'time' then {time} else x.value end"
    return f"map_from_entries(list_transform(map_entries({a}), lambda x: {{'key': x.key, 'value': {value}}}))"


MILLIS = "cast(floor(try_cast(ea['time'] as double) * 1000) as bigint)"
TIME_TEXT = f"coalesce(strftime(epoch_ms({MILLIS}), '%Y-%-m-%-d %-H:%-M:%-S.') || cast({MILLIS} % 1000 as varchar), ea['time'])"
DATED = f"case when ea['time'] is null then ea else {put('ea', 'time', TIME_TEXT)} end"
AGENTS = f"""ends as (select c, p, case when ca['type'] = 'Agent' then p else c end as v, case when ca['type'] = 'Agent' then ca when pa['type'] = 'Agent' then pa end as a from flat),
held as (select distinct v, md5({text("a")}) as agent from ends where a is not null), links as (select distinct c, p from ends where c <> p),
reach(src, dst) as (select c, p from links where c in (select v from held) union select reach.src, l.p from reach join links l on l.c = reach.dst),
pairs as (select distinct x.agent as g, y.agent as h from reach r join held x on x.v = r.src join held y on y.v = r.dst where x.v <> y.v),
names as (select md5({text("a")}) as agent, any_value(a) as a from ends where a is not null group by 1)"""
THREADS = f"""pr as (select * from (select *, row_number() over (partition by id order by seq) as k from s where kind = 'vertex' and lower(a['type']) = 'process') where k = 1),
th as (select seq, a as ca, map {{'type': 'Artifact', 'location': 'threadgroup:[' || coalesce(a['tgid'], 'null') || ']'}} as ga from pr),
te as (select seq, md5({text("ca")}) as c, md5({text("ga")}) as p, 'Used' as t from th union all select seq, md5({text("ga")}), md5({text("ca")}), 'WasGeneratedBy' from th)"""
NOISE = "regexp_matches(@['path'], '^(/tmp|pipe:|/unknown)') or regexp_full_match(@['path'], '.*scoreboard.*|[.]|stdin|[(]null[)]|/dev/null|stderr|stdout')"
DAY = put("coalesce(a, map())", "day", "strftime(event_time, case when kind = 'edge' then '%d/%m/%Y %H' else '%Y-%m-%d %H:%M:%S' end)")

def fold(group: str, ident: str, a: str, b: str) -> str:
    """One row a group: ``whole`` is the common annotations with those of the rules aggregated."""
    lists = ", ".join(f"list_sort(list({{'n': coalesce(try_cast({a}['{k}'] as double), 0), 't': {a}['{k}']}}) filter ({a}['{k}'] is not null)) as k{i}" for i, (k, _, _) in enumerate(AGGREGATIONS))
    shown = {"minmax": "k{0}[1].t || ', ' || k{0}[-1].t", "sum": "cast(cast(list_sum(list_transform(k{0}, lambda x: x.n)) as bigint) as varchar)", "list": "array_to_string(list_transform(k{0}, lambda x: x.t), ', ')", "count": "cast(len(k{0}) as varchar)"}
    new = ", ".join(f"{{'key': '{name}', 'value': case when len(k{i}) > 0 then '[' || {shown[how].format(i)} || ']' end}}" for i, (_, name, how) in enumerate(AGGREGATIONS))
    names = ", ".join(f"'{name}'" for _, name, _ in AGGREGATIONS)
    return f"select ident, map_from_entries(list_concat(list_filter(map_entries(b), lambda x: x.key not in ({names})), list_filter([{new}], lambda x: x.value is not null))) as whole from (select {ident} as ident, any_value({b}) as b, {lists} from {group} group by 1)"


KEYS = [k for k, _, _ in AGGREGATIONS]
GROUPED = f"""n0 as (select id, ea, c, ca, p, pa, {strip('ea', *KEYS)} as be, {strip('ca', *KEYS)} as bc, {strip('pa', *KEYS)} as bp from flat),
n1 as (select *, {vid('bc', 'c')} as nc, {vid('bp', 'p')} as np from n0), n2 as (select *, md5(nc || ',' || {text('be')} || ',' || np) as ne from n1),
en as (select v, old, any_value(a) as a, any_value(b) as b from (select nc as v, c as old, ca as a, bc as b from n2 union all select np, p, pa, bp from n2) group by 1, 2),
vs as ({fold('en', 'v', 'a', 'b')}), es as ({fold('n2', 'ne', 'ea', 'be')}), pairs as (select distinct ne, nc, np from n2)"""


def profile() -> str:
    """Features of processes, by DuckDB's own distinct counts."""
    out = []
    for name, test in (("used", "r"), ("made", "not r")):
        for tail, early in (("", ""), ("_beginning", " and early")):
            w = f"{test}{early}"
            out += [f"cast(count(*) filter ({w}) as double) as {name}_events{tail}", f"coalesce(sum(z) filter ({w}), 0) as {name}_length{tail}"]
            out += [f"cast(count(*) filter ({w} and {x}) as double) as {name}_{k}{tail}" for k, x in (("file_events", "f is not null"), ("sensitive_events", "ext in ('doc', 'docx', 'pdf', 'xls', 'xlsx', 'txt', 'csv')"), ("registry_events", "false"), ("network_events", "net"))]
            out += [f"count(distinct {x}) filter ({w}) as {name}_{k}{tail}" for k, x in (("files", "f"), ("directories", "regexp_extract(f, '^(.*)/[^/]*$', 1)"), ("extensions", "ext"))]
        out += [f"avg(t - {'lr' if name == 'used' else 'lw'}) filter ({test}) as {name}_between", f"cast(avg(0) filter ({test}) as double) as {name}_spent"]
    zero = ", ".join(f"coalesce({x.rsplit(' as ', 1)[1]}, 0) as {x.rsplit(' as ', 1)[1]}" for x in out if "between" not in x and "spent" not in x)
    return f"""with {STREAM}, {FEATURES.replace("as b from w0", "as b, a['operation'] as op from w0")},
x as (select *, t <= t0 + 1 as early, b['path'] as f, nullif(lower(regexp_extract(b['path'], '[.]([A-Za-z0-9]+)$', 1)), '') as ext, b['path'] is null and b['remote address'] is not null as net from w2),
y as (select q, {', '.join(out)} from x group by 1),
d as (select * from w0 where k = 1 and kind = 'edge'),
st as (select p, c, coalesce(ca['pid'] = pa['pid'], false) as th, ca['name'] as nm, ca['path'] as f from d where a['type'] = 'WasTriggeredBy'),
ids as (select q as id from y union select p from st union select c from st),
ends as (select c as q, ca as g, try_cast(a['time'] as double) as t from d union all select p, pa, try_cast(a['time'] as double) from d),
life as (select q, max(t) - min(t) as life from ends where g['type'] = 'Process' group by 1),
who as (select q, max(g['name']) as name, max(g['command line']) as command_line, max(g['pid']) as pid, max(g['ppid']) as ppid from ends group by 1),
us as (select c as q, arg_max(coalesce(pa['name'], pa['uid']), seq) as user from d where a['type'] = 'WasControlledBy' group by 1),
sn as (select p as q, cast(count(*) filter (not th) as double) as started, cast(count(*) filter (th) as double) as threads, count(distinct nm) filter (not th) as started_names from st group by 1),
rn as (select distinct st.p as q from st join x on x.q = st.p and not x.r and x.ext in ('exe', 'dll', 'bin', 'sh') and x.f = st.f)
select ids.id, {zero}, used_between, made_between, used_spent, made_spent, cast(0 as bigint) as registry_set_info, cast(0 as bigint) as registry_set_value, coalesce(started, 0) as started, coalesce(threads, 0) as threads, coalesce(started_names, 0) as started_names,
rn.q is not null as writes_then_executes, ids.id in (select c from st) as is_new, life, us.user as user, name, command_line, pid, ppid
from ids left join y on y.q = ids.id left join sn on sn.q = ids.id left join rn on rn.q = ids.id left join life on life.q = ids.id left join us on us.q = ids.id left join who on who.q = ids.id"""


SQL = {
    "t_opm_to_prov_tc": transformed(renamed_rows(typed(VERTEX_TYPES, EDGE_TYPES), {"operation": "cdmOperation", "uid": "owner"})),
    "t_prov_tc_to_opm": transformed(renamed_rows(typed({x: k for k, x in VERTEX_TYPES.items()}, {x: k for k, x in EDGE_TYPES.items()}), {"operation": "cdmOperation"})),
    "t_sanitization": transformed(f"select {hidden('ea')} as ea, c, {hidden('ca')} as ca, p, {hidden('pa')} as pa from (select {DATED} as ea, c, ca, p, pa from flat)"),
    "t_aggregation": transformed("select es.whole as ea, nc as c, x.whole as ca, np as p, y.whole as pa from pairs join es on es.ident = ne join vs x on x.ident = nc join vs y on y.ident = np", GROUPED),
    "t_only_agents": transformed("select map {'type': 'ActedOnBehalfOf'} as ea, g as c, x.a as ca, h as p, y.a as pa from pairs join names x on x.agent = g join names y on y.agent = h", AGENTS, True),
    "t_only_addresses": "with o as (select l_orderkey, l_linenumber, min('s' || cast(l_suppkey as varchar)) as payee from lineitem group by 1, 2) select distinct payee, 'c' || cast(o_custkey as varchar) as payer, cast(cast(l_quantity as integer) as varchar) as value from lineitem join o using (l_orderkey, l_linenumber) join orders on l_orderkey = o_orderkey",
    "t_blacklist_default": transformed(stripped(no("ca", NOISE) + " and " + no("pa", NOISE))),
    "t_no_ephemeral_reads_default": transformed(stripped(f"not coalesce({is_file('pa')} and {has_part('read', 'recv')} and regexp_matches(pa['path'], '([.]so([.].*)*|[.](conf|lock|pb|desktop|service))$') and (f is null or (p0 = p1 and p0 = coalesce(ca['pid'], ''))), false)", source="(select * from flat left join wr on wr.f = flat.p)"), ALONE_READ),
    "r_sample": f"with {BASE} select 'vertex' as kind, least(40, count(*)) as n, least(40, count(*)) as n_distinct, least(40, count(*)) as n_known from v union all select 'edge', least(40, count(*)), least(40, count(*)), least(40, count(*)) from e",
    "r_private_histogram": f"with {BASE} select a['operation'] as value, true as near from e where a['operation'] is not null group by 1",
    "f_convert_time": filtered(a=f"case when event_time is null then coalesce(a, map()) else {DAY} end", source="(select s.*, g.event_time from s join graph_element g using (seq))"),
    "f_attribute_label": f"with recursive {STREAM}, pv as (select id, max(cast(a['name'] = 'hedgerun' as integer)) as m from s where kind = 'vertex' and a['type'] = 'Process' and a['name'] is not null group by 1), es as (select distinct seq, c, p from s where kind = 'edge'), tt(id, since) as (select id, cast(-1 as bigint) from pv where m = 1 union select es.c, es.seq from tt join es on es.p = tt.id where es.seq > tt.since) select id, 'malicious' as label from tt group by 1 union all select id, 'benign' from pv where id not in (select id from tt)",
    "f_linux_threads": f"with {STREAM}, {THREADS} select seq, kind, id, {text('b')} as text from (select seq, kind, id, coalesce(a, map()) as b from s) union all select seq, 'edge', md5(c || ',{{type=' || t || '}},' || p), '{{type=' || t || '}}' from te union all select min(seq), 'vertex', md5({text('ga')}), any_value({text('ga')}) from th group by 3",
    "r_vertex_equal": _vertex("a['type'] = 'Process' and a['uid'] = '1001'"),
    "r_vertex_not_equal": _vertex("a['name'] <> 'loomd'"),
    "r_vertex_not": _vertex("not coalesce(a['name'] = 'loomd', false)"),
    "r_vertex_less": _vertex("a['pid'] < '2'"),
    "r_vertex_range": _vertex("a['pid'] >= '15' and a['pid'] <= '2' or a['version'] > '3'"),
    "r_vertex_like": _vertex("a['command line'] like '%job 1%'"),
    "r_vertex_not_like": _vertex("not coalesce(a['path'] like '/etc/%', false)"),
    "r_vertex_regex": _vertex("regexp_matches(a['path'], '[0-9]{3}[.](log|bin)')"),
    "r_vertex_any": _vertex("list_contains(map_values(a), '1001')"),
    "r_vertex_constraint": _vertex("a['type'] = 'Artifact' and a['subtype'] = 'file' and not coalesce(a['version'] = '0', false)"),
    "r_edge": _out(e="select id from e where a['type'] = 'Used' and a['operation'] = 'read'"),
    "r_edge_all": _out(e="select id from e"),
    "r_edge_with_endpoints": _out("select unnest([c, p]) as id from e where a['operation'] = 'fork'", "select id from e where a['operation'] = 'fork'"),
    "r_edge_endpoints": _out("select unnest([c, p]) as id from e where a['operation'] = 'fork'"),
    "r_edge_source": _out("select c as id from e where a['type'] = 'WasGeneratedBy'"),
    "r_edge_destination": _out("select p as id from e where a['type'] = 'WasGeneratedBy'"),
    "r_union": _vertex("a['type'] = 'Agent' or a['uid'] = '1001'"),
    "r_difference": _vertex("not coalesce(a['type'] = 'Agent', false)"),
    "r_intersection": _vertex("a['type'] = 'Process' and a['uid'] = '1001'"),
    "r_assign_ops": _vertex("a['type'] in ('Agent', 'Process') and not coalesce(a['uid'] = '1001', false) and len(list_filter(map_values(a), lambda x: x like '1%')) > 0"),
    "r_match": _out("select x.id from v x where x.a['type'] = 'Process' and x.a['uid'] in (select a['uid'] from v where a['type'] = 'Agent' and a['uid'] is not null) union select x.id from v x where x.a['type'] = 'Agent' and x.a['uid'] in (select a['uid'] from v where a['type'] = 'Process' and a['uid'] is not null)"),
    "r_neighbor_a": _out("select id from start union select p from e where c in (select id from start)", "select id from e where c in (select id from start)", START),
    "r_neighbor_both": _out("select id from start union select p from e where c in (select id from start) union select c from e where p in (select id from start)", "select id from e where c in (select id from start) or p in (select id from start)", START),
    "r_lineage_a": _lineage(3, "a"),
    "r_lineage_d": _lineage(2, "d"),
    "r_lineage_both": _lineage(2, "ad"),
    "r_path": _out("select id from x_v", "select id from x_e", f"{START}, {FILES}, {path('x', 'start', 'files', 3)}", True),
    "r_path_legs": _out("select id from x_v union select id from y_v", "select id from x_e union select id from y_e", f"{START}, {FILES}, via as (select id from v where a['name'] = 'loomd'), {path('x', 'start', 'via', 2)}, mid as (select id from x_v where id in (select id from via)), {path('y', 'mid', 'files', 2)}", True),
    "r_shortest_path": _out("select id from xv", "select id from xe", f"{START}, sock as (select id from v where a['subtype'] = 'network socket'), fw(s, id, d) as (select id, id, 0 from start union select fw.s, e.p, fw.d + 1 from fw join e on e.c = fw.id where fw.d < 6), f as (select s, id, min(d) as d from fw group by 1, 2), best as (select s, min(d) as b from f where id in (select id from sock) group by 1), {levels('t', 'sock', 6, 'p', 'c')}, xe as (select distinct e.* from f join best using (s) join e on e.c = f.id join t on t.id = e.p where f.d + 1 + t.d = b), xv as (select c as id from xe union select p from xe union select id from start where id in (select id from sock))", True),
    "r_path_lengths": f"with {BASE}, {START}, {FILES}, f0 as (select id from start), " + ", ".join(f"f{k} as (select distinct p as id from e where c in (select id from f{k - 1}) and p not in (select id from f{k - 1}))" for k in range(1, 5)) + " select cast(k as integer) as length from (" + " union all ".join(f"select {k} as k, (select count(*) from f{k} where id in (select id from files)) as n" for k in range(1, 5)) + ") where n > 0",
    "r_remote_lineage": _out("select id from a union select id from w union select id from met", "select id from eh where c in (select id from a where d < 3) union select id from et where c in (select id from w where d < 3)", f"""{START}, eh as (select * from e where id in (select {_h("hash")} from edges where source = 'audit')), et as (select * from e where id not in (select id from eh)), {levels('a', 'start', 3, 'c', 'p', 'eh')},
socks as (select id, a['local address'] || '|' || a['local port'] as l, a['remote address'] || '|' || a['remote port'] as r from v where a['subtype'] = 'network socket'),
met as (select x.id, min(a.d) as d from a join socks y on y.id = a.id join socks x on x.l = y.r and x.r = y.l group by 1), w(id, d) as (select id, d from met where d < 3 union select et.p, w.d + 1 from w join et on et.c = w.id where w.d < 3)""", True),
    "r_link": _out("select id from mid", "select id from e where c in (select id from mid) and p in (select id from mid)", f"{START}, sock as (select id from v where a['protocol'] = 'tcp'), u as (select c, p from e union select p, c from e), {levels('f', 'start', 2, 'c', 'p', 'u')}, {levels('b', 'sock', 2, 'c', 'p', 'u')}, mid as (select f.id from f join b using (id) where f.d + b.d <= 2)", True),
    "r_subgraph": _out("select id from q", "select id from e where c in (select id from q) and p in (select id from q)", "q as (select id from v where a['type'] = 'Process')"),
    "r_span": _out("select id from q", "select id from e where c in (select id from q) and p in (select id from q)", "q as (select id from v where id in (select unnest([c, p]) from e where a['operation'] = 'fork'))"),
    "r_collapse": _out("select id from v", "select min(id) as id from e group by c, p, a['type']"),
    "r_subset": _out("select id from (select id, row_number() over (order by id) - 1 as k, count(*) over () as n from v) where k >= 10 and k < n - 10", "select id from (select id, row_number() over (order by id) - 1 as k, count(*) over () as n from e) where k >= 10 and k < n - 10"),
    "r_limit": _out("select id from v order by id limit 25", "select id from e order by id limit 25"),
    "r_stat": f"with {BASE} select (select count(*) from v) as vertices, (select count(*) from e) as edges",
    "r_histogram": f"with {BASE} select a['operation'] as value, count(*) as n from e where a['operation'] is not null group by 1",
    "r_mean": f"with {BASE}, {SIZES} select round(avg(x), 6) as mean from x",
    "r_std": f"with {BASE}, {SIZES} select round(stddev_samp(x), 6) as std from x",
    "r_distribution": f"""with {BASE}, {SIZES}, m as (select min(x) as lo, max(x) as hi, (max(x) - min(x) + 1) / 7 as st from x),
b as (select lo + i * st as low, case when lo + (i + 1) * st < hi then lo + (i + 1) * st else hi end as high, lo + (i + 1) * st >= hi as last from m, range(0, 7) t(i) where i = 0 or lo + i * st < hi)
select round(low, 6) as low, round(high, 6) as high, (select count(*) from x where x.x >= b.low and (x.x < b.high or b.last and x.x <= b.high)) as n from b""",
    "r_describe_keys": f"with {BASE} select distinct unnest(map_keys(a)) as key from v",
    "r_describe_count": f"with {BASE} select a['type'] as value, count(*) as n from e where a['type'] is not null group by 1",
    "r_describe_minmax": f"with {BASE} select min(a['pid']) as min, max(a['pid']) as max from v",
    "r_native": f"with {BASE} select a['type'] as kind, count(*) as n from v group by 1",
    "r_comments_and_escapes": _vertex("a['path'] like '/tmp/%1%' or a['name'] = 'hedgerun'"),
    "r_empty": _out("select id from v where false", "select id from e where false"),
    "r_unknown_key_not": _vertex("true"),
    "r_local_lineage": _lineage(2, "d"),
    "r_link_of_subset": _out("select id from mid", "select id from part where c in (select id from mid) and p in (select id from mid)", f"{START}, sock as (select id from v where a['protocol'] = 'tcp'), part as (select * from e where a['type'] in ('Used', 'WasGeneratedBy')), u as (select c, p from part union select p, c from part), {levels('f', 'start', 2, 'c', 'p', 'u')}, {levels('b', 'sock', 2, 'c', 'p', 'u')}, mid as (select f.id from f join b using (id) where f.d + b.d <= 2)", True),
    "r_size_guard": f"with {BASE} select avg(try_cast(a['pid'] as double)) as mean from v where false having count(*) > 0",
    "r_list": f"with {BASE}, {START} select 'graph' as kind, '$base' as name, (select count(*) from v) || ' vertices, ' || (select count(*) from e) || ' edges' as value union all select 'graph', '$start', (select count(*) from start) || ' vertices, 0 edges' union all select 'constraint', '%p', '(\"name\" = ''x'')' union all select 'env', * from (values ('exportLimit', '4096'), ('limit', '7'), ('maxDepth', 'UNDEFINED'), ('precision', '3'))",
    "r_native_braces": f"with {BASE} select count(*) as n from v where regexp_matches(a['pid'], '^[0-9]{{3}}$')",
    "r_edge_literals": _out(e="select id from e where a['operation'] = 'fork' order by id limit 20"),
    "r_dump_constraint": """select '(((\"a\" = ''1'') or (not (\"b\" like ''x''))) and (\"c\" > ''2''))' as text""",
    "r_dump": _out("select unnest([c, p]) as id from e where a['operation'] = 'fork'", "select id from e where a['operation'] = 'fork'"),
    "r_export_guard": "select true as refused",
    "r_workspace": "select '$b %p' as left, cast(0 as integer) as after_reset",
    "r_refine": _out("select id from x_v union select id from y_v", "select id from x_e union select id from y_e", f"""fs as (select c as id from e where a['operation'] = 'fork'), rd as (select p as id from e where a['operation'] = 'read'), ws as (select c as id from e where a['operation'] = 'write'), fd as (select p as id from e where a['operation'] = 'fork'), {path('x', 'fs', 'rd', 2)}, {path('y', 'ws', 'fd', 2)}""", True),
    "r_remote_create": _out("select id from (select id from v order by id limit 3)"),
    "r_literals": _out("select id from v where a['type'] = 'Agent' order by id limit 20"),
    "r_with_keys": _vertex("a['local address'] is not null and a['remote port'] is not null"),
    "r_identity": f"with {BASE} select id, md5({text('a')}) as content_id from v union all select id, md5(c || ',' || {text('a')} || ',' || p) from e",
    "r_export": f"with {BASE}, w as (select unnest([c, p]) as id from e) select 'vertex' as kind, w.id, cast(coalesce(cardinality(v.a), 0) as integer) as n from (select distinct id from w) w left join v on v.id = w.id union all select 'edge', id, cast(cardinality(a) as integer) from e",
    "r_attribute_rows": f"with {BASE} select id, unnest(map_entries(a)).key as field, unnest(map_entries(a)).value as value from v",
    "r_adjacency": f"with {BASE} select c as id, string_agg(p, ',' order by p) as neighbours from (select distinct c, p from e) group by 1",
    "t_last_name": transformed(stripped(f"not coalesce(ea['operation'] in ('mmap', 'rename', 'link'), false) and not ({has_part('mmap', 'rename', 'link')} and {has_part('read')})")),
    "t_merge_io": transformed(stripped("true", "time", "size")),
    "t_no_memory": transformed(stripped(no("ca", "@['subtype'] = 'memory'") + " and " + no("pa", "@['subtype'] = 'memory'"))),
    "t_no_units": transformed(stripped("ea['operation'] is distinct from 'unit'", "unit")),
    "t_no_versions": transformed(stripped("ea['operation'] is distinct from 'update'", "version")),
    "t_drop_keys": transformed(stripped("true", "event id", "size", "time")),
    "t_blacklist": transformed(stripped(no("ca", "regexp_matches(@['path'], '^/(etc|tmp)/')") + " and " + no("pa", "regexp_matches(@['path'], '^/(etc|tmp)/')"))),
    "t_no_ephemeral_reads": transformed(stripped(f"not ({is_file('pa')} and {has_part('read', 'recv')} and (f is null or (p0 = p1 and p0 = coalesce(ca['pid'], ''))))", source="(select * from flat left join wr on wr.f = flat.p)"), ALONE_READ),
    "t_no_ephemeral_writes": transformed(stripped(f"not ({is_file('ca')} and {has_part('write', 'send')} and (f is null or (p0 = p1 and p0 = coalesce(pa['pid'], ''))))", source="(select * from flat left join rd on rd.f = flat.c)"), ALONE_WRITE),
    "t_opm_to_prov": transformed(typed(VERTEX_TYPES, EDGE_TYPES)),
    "t_prov_to_opm": transformed(typed({x: k for k, x in VERTEX_TYPES.items()}, {x: k for k, x in EDGE_TYPES.items()})),
    "t_temporal_a": transformed(stripped("coalesce(try_cast(ea['event id'] as double) <= (select b from bound), try_cast(ea['event id'] as double) is null)"), f"{START}, bound as (select max(try_cast(ea['event id'] as double)) as b from flat where c in (select id from start) or p in (select id from start))"),
    "t_temporal_d": transformed(stripped("coalesce(try_cast(ea['time'] as double) >= (select b from bound), try_cast(ea['time'] as double) is null)"), f"{START}, bound as (select min(try_cast(ea['time'] as double)) as b from flat where c in (select id from start) or p in (select id from start))"),
    "t_prune": transformed(stripped(f"id not in ({lineage(2, 'a')[2]})"), f"{START}, {lineage(2, 'a')[0]}", True),
    "f_add_annotation": filtered(a=put("a", "host", "'h1'")),
    "f_drop_keys": filtered(a="map_from_entries(list_filter(map_entries(a), lambda x: x.key not in ('time', 'event id')))"),
    "f_blacklist": filtered("case when kind = 'edge' then " + no("ca", "regexp_matches(@['path'], '^/(etc|usr)/')") + " and " + no("pa", "regexp_matches(@['path'], '^/(etc|usr)/')") + " else " + no("a", "regexp_matches(@['path'], '^/(etc|usr)/')") + " end"),
    "f_filter_provenance": filtered(no("a", "@['uid'] = '1001'") + " and not (kind = 'edge' and (coalesce(ca['uid'] = '1001', false) or coalesce(pa['uid'] = '1001', false)))"),
    "f_drop_principals": filtered("case when kind = 'edge' then a['type'] is distinct from 'Edge' else a['type'] is distinct from 'Principal' end"),
    "t_simple_forks": transformed(FORKS, FIRSTS),
    "f_opm_to_prov": filtered(f"{NEW_TYPE} is not null", put("a", "type", NEW_TYPE)),
    "f_opm_to_prov_tc": filtered(a=f"map_from_entries(list_transform(map_entries(case when {NEW_TYPE} is not null then {put('a', 'type', NEW_TYPE)} else a end), lambda x: {{'key': case when x.key = 'operation' then 'cdmOperation' else x.key end, 'value': x.value}}))"),
    "f_process_features": f"""with {STREAM}, {FEATURES} select q as id, count(*) filter (r) as n_reads, count(*) filter (not r) as n_writes, avg(case when r then t - lr end) as avg_between_reads, avg(case when not r then t - lw end) as avg_between_writes,
count(distinct b['path']) as n_files, count(distinct nullif(regexp_extract(b['path'], '[.]([A-Za-z0-9]+)$', 1), '')) as n_extensions, count(distinct b['remote address']) as n_hosts, sum(case when r then z else 0 end) as bytes_read, sum(case when not r then z else 0 end) as bytes_written,
count(*) filter (t <= t0 + 1) as n_beginning, count(distinct case when t <= t0 + 1 then b['path'] end) as n_files_beginning, min(t) as first_time, max(t) as last_time from w2 group by 1""",
    "f_process_profile": profile(),
    "f_version_on_write": f"with {STREAM}, {ON_WRITE}, " + versioned(f"select seq, a, {bumped('ca', 'nc + 1')} as ca, {bumped('pa', 'np')} as pa from x union all select seq, {CHAIN}, {bumped('ca', 'nc + 1')}, {bumped('ca', 'nc')} from x"),
    "f_version_process": f"with {STREAM}, {ON_READ}, " + versioned(f"select seq, a, {bumped('ca', 'nc + 1')} as ca, pa from x union all select seq, {CHAIN}, {bumped('ca', 'nc + 1')}, {bumped('ca', 'nc')} from x"),
    "f_deduplicate": filtered("k = 1", source="(select *, row_number() over (partition by id order by seq) as k from s)"),
    "f_drop_repeat_edges": filtered("kind = 'vertex' or k = 1 or o is distinct from a['operation']", source="(select *, lag(a['operation']) over (partition by kind, c, p order by seq) as o, row_number() over (partition by kind, c, p order by seq) as k from s)"),
    "f_io_runs": f"with {STREAM}, {IO} select seq, kind, id, {text('a')} as text from (select seq, kind, id, coalesce(a, map()) as a from io2 where l is null or l <> a['type'] union all select seq, kind, id, coalesce(a, map()) from s where kind = 'vertex' or seq not in (select seq from io2))",
    "f_audit_sanity": f"with {STREAM}, f1 as (select id, min(seq) as seen from s where kind = 'vertex' group by 1), w as (select seq, id, unnest([c, p]) as endpoint from s where kind = 'edge') select distinct w.seq, w.id, w.endpoint from w left join f1 on f1.id = w.endpoint where seen is null or seen > w.seq",
    "f_cross_namespaces": f"with {STREAM}, w as (select {named('ca', ('path', 'version'))} as artifact, {named('pa', ('uid',))} as writer, min(seq) as seen from s where kind = 'edge' and a['type'] = 'WasGeneratedBy' group by 1, 2), r as (select seq, {named('pa', ('path', 'version'))} as artifact, {named('ca', ('uid',))} as reader from s where kind = 'edge' and a['type'] = 'Used') select seq, artifact, reader, writer from r join w using (artifact) where artifact <> '[]' and writer <> '[]' and reader <> '[]' and writer <> reader and seen < seq",
    "f_artifact_features": f"with {STREAM}, w as (select case when a['type'] = 'Used' then p else c end as id, case when a['type'] = 'Used' then c else p end as q, a['type'] = 'Used' as r from s where kind = 'edge' and a['type'] in ('Used', 'WasGeneratedBy')) select id, count(*) filter (r) as n_reads, count(*) filter (not r) as n_writes, count(distinct case when r then q end) as n_readers, count(distinct case when not r then q end) as n_writers from w group by 1",
}
