"""The same results in SQL, for the checks against another engine."""

_CLEAN = "regexp_replace(replace({c}, '\\', '/'), '^(?:\\./)+', '')"
_STRIP = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))"


def clean(c: str) -> str:
    return _CLEAN.format(c=c)


def strip(c: str) -> str:
    return _STRIP.format(c=c)


P1 = f"""
with j as (select *, row_number() over (partition by id order by updated_at desc nulls last, completed_at desc nulls last, status desc nulls last, repository_id desc nulls last) n from analysis_jobs),
s as (select id, repository_id, row_number() over w pos, lead(id) over w nxt from j where n = 1 and status = 'completed'
      window w as (partition by repository_id order by completed_at nulls last, id)),
i as (select {strip('rule_id')} rule_id, {clean('file_path')} file_path,
        coalesce(nullif({strip('symbol_name')}, ''), nullif(metadata_json->>'$.target_identifier', ''), 'file') issue_scope,
        severity, coalesce(metadata_json, '{{}}') m, created_at, a.id, s.id sid, repository_id, pos, nxt
      from analysis_issues a join s on a.analysis_id = s.id),
d as (select * from (select *, row_number() over (partition by sid, rule_id, file_path, issue_scope order by created_at desc nulls last, id desc nulls last) n from i) where n = 1),
pairs as (
  select coalesce(h.sid, b.nxt) analysis_id, coalesce(h.rule_id, b.rule_id) rule_id, coalesce(h.file_path, b.file_path) file_path, coalesce(h.issue_scope, b.issue_scope) issue_scope,
    b.sid bs, h.sid hs, b.severity bsev, h.severity hsev, b.m bm, h.m hm, h.pos hpos
  from d b full join d h on b.nxt = h.sid and b.rule_id is not distinct from h.rule_id and b.file_path is not distinct from h.file_path and b.issue_scope = h.issue_scope),
texts as (select distinct m from i),
leaves as (select t.m, e.fullkey || ':' || e.type_class || ':' || coalesce(case when e.type_class = 'n' then cast(cast(e.atom as double) as varchar) else e.atom->>'$' end, '') v
  from texts t, lateral (select fullkey, atom, case when type in ('UBIGINT','BIGINT','DOUBLE','HUGEINT') then 'n' else type end type_class from json_tree(t.m)) e),
canon as (select m, string_agg(v, chr(1) order by v) c from leaves group by m)
select analysis_id, rule_id, file_path, issue_scope,
  case when bs is null then 'added' when hs is null then 'removed' else 'changed' end change_kind
from pairs left join canon cb on cb.m = bm left join canon ch on ch.m = hm
where (bs is null and hpos > 1) or (hs is null and analysis_id is not null) or (bs is not null and hs is not null and (bsev is distinct from hsev or cb.c <> ch.c))
"""

_TREE = """
with recursive n as (select lower(id) id, arg_max({value}, created_at) v from symbols where id is not null and id <> '' group by 1),
d as (select id, v.parent parent, v.name name from n),
t as (select id, id root, 0 depth, coalesce(name, '') path from d where parent is null or parent not in (select id from d)
      union all select d.id, t.root, t.depth + 1, t.path || '.' || coalesce(d.name, '') from d join t on d.parent = t.id),
u as (select id, parent from d where id not in (select id from t)),
w as (select id start, parent cur, id || '' low, 1 n from u union all select start, u.parent, w.low, n + 1 from w join u on u.id = w.cur where n <= (select count(*) from u) and cur <> start),
c as (select distinct start id from w where cur = start),
m as (select c.id, c.id cur, c.id low, 0 n from c union all select m.id, u.parent, least(m.low, u.parent), n + 1 from m join u on u.id = m.cur where u.parent <> m.id),
r as (select id, min(low) low from m group by id),
z as (select id, low from r union all select u.id, z.low from u join z on u.parent = z.id where u.id not in (select id from c))
""".replace("{value}", "{'parent': nullif(lower(parent_symbol_id), ''), 'name': name}")
P2 = _TREE + """
select id symbol_id, root root_id, depth tree_depth from t
union all select id, low, -1 from z
"""
P2_PATHS = _TREE + """
select id symbol_id, root root_id, depth tree_depth, path from t
union all select id, low, -1, null from z
"""
P2_DESCENDANTS = """
with recursive n as (select lower(id) id, arg_max({'parent': nullif(lower(parent_symbol_id), '')}, created_at) v from symbols where id is not null and id <> '' group by 1),
d as (select id, v.parent parent from n),
t as (select id from d where parent is null or parent not in (select id from d) union all select d.id from d join t on d.parent = t.id),
p as (select parent a, id d, 1 k from d where id in (select id from t) and parent in (select id from d)
      union all select d.parent, p.d, k + 1 from p join d on d.id = p.a where d.parent in (select id from d))
select a ancestor_id, d descendant_id, k distance from p
"""
