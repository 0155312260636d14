"""The same results in SQL, for the checks against another engine."""

_CLEAN = "regexp_replace(replace({c}, '\\', '/'), '^(?:\\./)+', '')"


def clean(c: str) -> str:
    return _CLEAN.format(c=c)


P3 = f"""
with recursive r as (select analysis_id s, {clean('source_file_path')} a, {clean('target_file_path')} b, nullif(fragment_hash, '') k from code_duplicates),
v as (select s, a x from r union select s, b from r),
h as (select s, k, min(x) m from (select s, k, a x from r where k is not null union all select s, k, b from r where k is not null) group by s, k),
e as (select s, a u, b w from r union select s, b, a from r
      union select r.s, r.a, h.m from r join h on r.s is not distinct from h.s and r.k = h.k union select r.s, h.m, r.a from r join h on r.s is not distinct from h.s and r.k = h.k),
reach as (select s, x, x y from v union select q.s, q.x, e.w from reach q join e on e.s is not distinct from q.s and e.u = q.y)
select s analysis_id, x file_path, min(y) group_id from reach group by s, x
"""

P6 = f"""
with t as (select *, {clean('file_path')} p from file_metrics where analysis_id is not null and file_path is not null),
l as (select * from (select *, row_number() over (partition by analysis_id, p order by created_at desc nulls last, id desc nulls last) n from t) where n = 1 and hotspot_score is not null and not isnan(hotspot_score)),
r as (select analysis_id, p file_path, row_number() over (partition by analysis_id order by hotspot_score desc,
        coalesce(nullif(architectural_centrality, 'nan'::double), '-inf'::double) desc, coalesce(nullif(complexity_risk, 'nan'::double), '-inf'::double) desc, coalesce(nullif(issue_severity_burden, 'nan'::double), '-inf'::double) desc, p) hotspot_rank from l)
select analysis_id, cast(hotspot_rank as int) hotspot_rank, file_path from r where hotspot_rank <= 10
"""
