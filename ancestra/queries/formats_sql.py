"""The round trips of formats as DuckDB SQL over the tables."""

from __future__ import annotations

from ancestra.queries.reference_sql import BASE, text

PROV_NAMES = {"Used": "used", "WasGeneratedBy": "wasGeneratedBy", "WasDerivedFrom": "wasDerivedFrom", "WasInformedBy": "wasInformedBy", "WasAssociatedWith": "wasAssociatedWith", "WasAttributedTo": "wasAttributedTo", "ActedOnBehalfOf": "actedOnBehalfOf"}


def ref(c: str) -> str:
    """The id of an element known by a name: the name if it is an MD5."""
    return f"case when regexp_full_match({c}, '[0-9a-fA-F]{{32}}') then lower({c}) else md5('{{id=' || {c} || '}}') end"


def content(v: str = "true", e: str = "true", a: str = "a", named: bool = False) -> str:
    """(kind, id, child, parent, text) of vertices and edges; ``named`` if ids are read as names."""
    own = ref if named else str
    return f"""with {BASE} select 'vertex' as kind, {own('id')} as id, cast(null as varchar) as child, cast(null as varchar) as parent, {text(a)} as text from v where {v}
union all select distinct 'edge', null, {own('c')}, {own('p')}, {text(a)} from e where {e}"""


TYPED = "a['type'] is not null and a['type'] <> ''"
NAMED = "map_from_entries(list_filter(map_entries(a), lambda x: x.key <> 'id' and x.value is not null))"
RELATION = "case a['type'] " + " ".join(f"when '{k}' then '{x}'" for k, x in PROV_NAMES.items()) + " end"
VERTEX_TYPES = "'Vertex', 'Entity', 'Agent', 'Activity', 'Process', 'Artifact', 'Principal', 'Object', 'Subject', 'Event'"
ATTRIBUTES = """array_to_string(list_transform(list_sort(list_filter(map_entries(a), lambda x: x.key <> 'type' and x.value is not null)), lambda x: 'data:' || regexp_replace(trim(x.key), '\\s+', '_', 'g') || '="' || regexp_replace(x.value, '["\\\\]', '''', 'g') || '"'), ', ')"""

SQL = {
    "s_parquet": content(),
    "s_messages": content(),
    "s_jdbc": content(),
    "s_json": content(TYPED, TYPED, NAMED, True),
    "s_dot": content(named=True),
    "s_text": content(),
    "s_datalog": f"with {BASE} select 'parent(''' || c || ''',''' || p || ''').' as line from e union all select unnest(['', 'ancestor(?x, ?y) :- parent(?x, ?y).', 'ancestor(?x, ?y) :- parent(?x, ?z), ancestor(?z, ?y).'])",
    "s_turtle": f"with {BASE} select 'data:' || c || ' prov:' || {RELATION} || ' data:' || p || ' .' as line from e where {RELATION} is not null",
    "s_provn": f"with {BASE} select {RELATION} || '(data:' || c || ', data:' || p || ', [' || {ATTRIBUTES} || '])' as line from e where {RELATION} is not null union all select unnest(['document', 'endDocument'])",
    "s_dsl": content(f"a['type'] in ({VERTEX_TYPES})", "false", "map_from_entries(list_filter(map_entries(a), lambda x: lower(x.key) not in ('id', 'from', 'to')))", True),
    "s_audit": r"""with l as (select regexp_replace(coalesce(msg, ''), '[\r\n]', '', 'g') as m from log_line),
r as (select regexp_extract(m, '^(?:node=\S+ )?type=(\S+) msg=audit\((\d+\.\d+):(\d+)\): ?(.*)$', ['record', 'time', 'event_id', 'rest']) as x from l where regexp_matches(m, '^(?:node=\S+ )?type=(\S+) msg=audit\((\d+\.\d+):(\d+)\): ?(.*)$')),
f as (select x.time as time, x.event_id as event_id, x.record as record, regexp_extract_all(x.rest, '[\w-]+=(?:"[^"]*"|\S+)') as ts, row_number() over () as n from r),
p as (select n, time, event_id, record, u.t as t, u.i as i from (select *, unnest(list_transform(ts, lambda t, i: {'t': t, 'i': i})) as u from f)),
q as (select n, split_part(t, '=', 1) as k, arg_max(regexp_replace(t[strpos(t, '=') + 1:], '^"|"$', '', 'g'), i) as v from p group by 1, 2),
w as (select n, string_agg(k || '=' || v, ', ' order by k) as body from q group by 1)
select time, event_id, record, '{' || coalesce(body, '') || '}' as text from f left join w using (n)""",
}
