"""The stored-table queries in SQL."""

from quarry.plans.sql_core import clean
from quarry.sources.discovery import IGNORED_FOLDERS, IGNORED_SUFFIXES, LANGUAGE_NAMES, LANGUAGE_SUFFIXES

_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_LANGUAGES = ", ".join(f"('{s}', '{lang}')" for lang, suffixes in LANGUAGE_SUFFIXES.items() for s in suffixes.split())
_NAMES = ", ".join(f"('{n}', '{lang}')" for n, lang in LANGUAGE_NAMES.items())

_JOBS = "(select * from (select *, row_number() over (partition by id order by updated_at desc nulls last, completed_at desc nulls last, status desc nulls last, repository_id desc nulls last) n from analysis_jobs) where n = 1)"
_FILES = f"""(select analysis_id, path, id, size_bytes, content from (select analysis_id, {clean('path')} path, id, size_bytes, content,
  row_number() over (partition by analysis_id, {clean('path')} order by created_at desc, id desc) n from repository_files) where n = 1)"""
_SCORED = f"""(select * from (select *, {clean('file_path')} p, row_number() over (partition by analysis_id, {clean('file_path')} order by created_at desc, id desc) n from file_metrics where analysis_id is not null) where n = 1)"""
_DUP = f"(select *, {clean('source_file_path')} sp, {clean('target_file_path')} tp from code_duplicates)"
_NUMSTAT = "(select l_orderkey \"commit\", o_custkey author, 'src/part_' || l_partkey || '.py' path, cast(trunc(l_quantity) as int) added, l_linenumber deleted from lineitem join orders on l_orderkey = o_orderkey)"
_RANK = "case severity when 'blocker' then 0 when 'critical' then 1 when 'major' then 2 when 'minor' then 3 when 'info' then 4 else 5 end"
_PRINT = """sha256(trim(coalesce(rule_id, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) || ':' || trim(regexp_replace(replace(coalesce(file_path, ''), '\\', '/'), '^[./]+', ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) || ':' ||
  case when trim(coalesce(symbol_name, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> '' then trim(symbol_name, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))
    when coalesce(metadata_json->>'$.target_identifier', '') <> '' then trim(metadata_json->>'$.target_identifier', chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))
    when coalesce(metadata_json->>'$.target_file_path', '') <> '' then 'dup_' || (metadata_json->>'$.target_file_path') || '_' || coalesce(metadata_json->>'$.target_start_line', 'None') || '_' || coalesce(metadata_json->>'$.target_end_line', 'None')
    else 'file' end)"""
_EDGES = f"(select distinct analysis_id, sp src, tp dst from {_DUP} where sp is not null and tp is not null)"
_CYCLES = f"""with recursive e as {_EDGES},
p(g, st, cur, path) as (select analysis_id, src, dst, [src, dst] from e where dst > src
  union all select p.g, p.st, e.dst, list_append(p.path, e.dst) from p join e on e.analysis_id = p.g and p.cur = e.src where len(p.path) < 15 and e.dst > p.st and not list_contains(p.path, e.dst)),
long as (select g, path from p join e on e.analysis_id = p.g and p.cur = e.src and e.dst = p.st),
al as (select g, path from long union all select analysis_id, [src] from e where src = dst and not exists (select 1 from long where g = analysis_id and list_contains(path, src))),
n as (select *, row_number() over (partition by g order by path) cycle_id, count(*) over (partition by g) > 100 cap_reached from al), c as (select * from n where cycle_id <= 100)
"""
_DEGREE = f"""e as (select distinct analysis_id, sp src, tp dst from {_DUP} where sp is not null and tp is not null),
n as (select analysis_id, src node from e union select analysis_id, dst from e),
o as (select analysis_id, src node, count(*) c from e group by all), i as (select analysis_id, dst node, count(*) c from e group by all),
g as (select n.analysis_id, n.node, coalesce(i.c, 0) fan_in, coalesce(o.c, 0) fan_out, case when coalesce(i.c, 0) + coalesce(o.c, 0) > 0 then round(coalesce(o.c, 0) / (coalesce(i.c, 0) + coalesce(o.c, 0)), 4) else 0.0 end instability
  from n left join o using (analysis_id, node) left join i using (analysis_id, node))
"""
_RANGES = f"""r as (select analysis_id, sp file_path, source_start_line s, source_end_line e from {_DUP} union select analysis_id, tp, target_start_line, target_end_line from {_DUP}),
m as (select *, max(e) over (partition by analysis_id, file_path order by s, e rows between unbounded preceding and 1 preceding) reach from r where s is not null and e is not null),
k as (select *, sum(case when reach is null or s > reach + 1 then 1 else 0 end) over (partition by analysis_id, file_path order by s, e rows unbounded preceding) island from m),
l as (select analysis_id, file_path, cast(sum(e2 - s2 + 1) as bigint) duplicated_lines from (select analysis_id, file_path, island, min(s) s2, max(e) e2 from k group by all) group by all)
"""


def _impact(a: str, b: str, depth: int = 5) -> str:
    """Breadth first, level by level; of a node's shortest paths the least."""
    out = f"with e as (select distinct analysis_id g, {a} a, {b} b from {_EDGES}), l0 as (select distinct g, unnest([a, b]) target, unnest([a, b]) node, [unnest([a, b])] path from e)"
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select g, target, node from l{i}" for i in range(k))
        out += f", s{k} as ({seen}), l{k} as (select l.g, l.target, e.b node, min(list_append(l.path, e.b)) path from l{k - 1} l join e on e.g = l.g and e.a = l.node anti join s{k} s on s.g = l.g and s.target = l.target and s.node = e.b group by 1, 2, 3)"
    parts = " union all ".join(f"select g analysis_id, target, node, {k} as \"depth\", array_to_string(path, '>') path, '{'direct' if k == 1 else 'transitive'}' relation from l{k}" for k in range(1, depth + 1))
    return out + " " + parts


SQL = {
    "url_validation": """
with t as (select id, unnest([url, url || '/x', regexp_replace(url, '^https', 'http'), url || '.git']) raw from repositories),
p as (select *, regexp_extract(raw, '^([a-z]+)://', 1) scheme, regexp_extract(raw, '^[a-z]+://([^/]*)', 1) host, string_split(regexp_replace(raw, '^[a-z]+://[^/]*/', ''), '/') seg from t)
select id, raw, case when scheme <> 'https' then 'not https' when len(seg) <> 2 then 'not owner/name' when host not in ('code.example', 'scm.test', 'git.example') then 'host not allowed' end error,
  case when scheme = 'https' and len(seg) = 2 and host in ('code.example', 'scm.test', 'git.example') then seg[1] end valid_owner,
  case when scheme = 'https' and len(seg) = 2 and host in ('code.example', 'scm.test', 'git.example') then regexp_replace(seg[2], '\\.git$', '') end valid_name from p""",
    "discovered_files": f"""
with ls(s, lang) as (values {_LANGUAGES}), ns(n, lang) as (values {_NAMES}),
f as (select *, string_split(path, '/')[-1] filename, string_split(path, '/')[:-2] folders from {_FILES}),
x as (select *, lower(regexp_extract(filename, '^.+(\\.[^.]*)$', 1)) extension from f)
select analysis_id, id, path, filename, extension, coalesce(ns.lang, ls.lang) as "language", coalesce(ns.lang, ls.lang) is not null and coalesce(ns.lang, ls.lang) <> 'Markdown' is_analyzable,
  coalesce(case when size_bytes <= 10485760 then length(content) - length(replace(content, chr(10), '')) end, -1) line_count
from x left join ns on ns.n = lower(filename) left join ls on ls.s = extension
where extension not in ({_LIST(IGNORED_SUFFIXES)}) and len([d for d in folders if lower(d) in ({_LIST(IGNORED_FOLDERS)}) or starts_with(d, '.git')]) = 0""",
    "job_status": f"select j.id, j.repository_id, r.url, r.name, j.status from {_JOBS} j join repositories r on r.id = j.repository_id",
    "stale_jobs": f"select id, status, updated_at from {_JOBS} where status not in ('completed', 'failed', 'cancelled') and (updated_at is null or updated_at <= timestamp '2024-12-31 23:30:00')",
    "cancel_outcomes": f"""select id, status, case when status in ('completed', 'failed') then 'conflict' when status = 'cancelled' then 'already cancelled' when status = 'queued' then 'cancelled' else 'requested' end outcome,
  case when status in ('completed', 'failed', 'cancelled') then status when status = 'queued' then 'cancelled' else 'cancellation_requested' end new_status from {_JOBS} where completed_at is null""",
    "symbol_search": f"""select s.id, s.file_id, f.path, s.name, s.qualified_name, s.start_line, s.start_column from symbols s join (select distinct id, {clean('path')} path from repository_files) f on f.id = s.file_id
  where s.symbol_type = 'method' and (s.name ilike '%ledger%' or s.qualified_name ilike '%ledger%')""",
    "symbol_page": f"""select s.id, f.path, s.name, s.start_line, s.start_column from symbols s join (select distinct id, {clean('path')} path from repository_files) f on f.id = s.file_id
  order by f.path nulls first, s.start_line nulls first, s.start_column nulls first, s.id nulls first, s.name nulls first, s.created_at nulls first limit 50 offset 100""",
    "issue_search": f"select id, analysis_id, rule_id, severity, {_RANK} severity_rank, title from analysis_issues where lower(severity) = 'major' and (title ilike '%ledger%' or description ilike '%ledger%' or file_path ilike '%ledger%' or symbol_name ilike '%ledger%')",
    "issue_page": f"select id, rule_id, severity, {_RANK} severity_rank from analysis_issues order by severity_rank nulls first, rule_id nulls first, created_at nulls first, id nulls first, file_path nulls first, line_number nulls first, title nulls first limit 100",
    "issue_summary": """select analysis_id, severity, category, count(*) issues, cast(coalesce(sum(remediation_effort_minutes), 0) as bigint) as "minutes", cast(grouping(severity) * 2 + grouping(category) as int) as "level"
  from analysis_issues group by grouping sets ((analysis_id, severity), (analysis_id, category), (analysis_id))""",
    "top_rules": "select * from (select analysis_id, rule_id, count(*) issues, cast(row_number() over (partition by analysis_id order by count(*) desc, rule_id) as int) \"position\" from analysis_issues group by 1, 2) where \"position\" <= 10",
    "issue_fingerprints": f"select analysis_id, {_PRINT} fingerprint, count(*) as \"rows\" from analysis_issues group by 1, 2",
    "timeline": f"select repository_id, id, cast(row_number() over (partition by repository_id order by commit_date nulls last, created_at nulls last, id) as int) \"position\", commit_date from {_JOBS} where status = 'completed'",
    "hotspot_ranking": f"""
with c as (select analysis_id, p file_path,
  round(greatest(0, least(100, coalesce(sloc, 0) / 1000.0::double * 40.0::double + coalesce(max_cyclomatic_complexity, 0) / 20.0::double * 40.0::double + coalesce(max_nesting_depth, 0) / 5.0::double * 20.0::double)), 1) complexity_risk,
  round(greatest(0, least(100, coalesce(fan_in, 0) / 10.0::double * 60.0::double + coalesce(fan_out, 0) / 10.0::double * 40.0::double)), 1) architectural_centrality,
  round(greatest(0, least(100, coalesce(blocker_count, 0) * 40.0::double + coalesce(critical_count, 0) * 25.0::double + coalesce(major_count, 0) * 10.0::double + coalesce(minor_count, 0) * 2.0::double)), 1) issue_severity_burden from {_SCORED}),
h as (select *, round(complexity_risk * 0.4::double + architectural_centrality * 0.35::double + issue_severity_burden * 0.25::double, 1) hotspot_score from c)
select * from (select *, cast(row_number() over (partition by analysis_id order by hotspot_score desc, architectural_centrality desc, complexity_risk desc, issue_severity_burden desc, file_path) as int) as "rank" from h) where "rank" <= 10""",
    "duplicated_lines": f"with {_RANGES} select * from l",
    "duplication_scores": f"""with {_RANGES}, d as (select analysis_id, cast(sum(duplicated_lines) as bigint) d from l group by 1), b as (select analysis_id, count(distinct id) b from code_duplicates group by 1),
s as (select analysis_id, cast(sum(coalesce(sloc, 0)) as bigint) sloc from {_SCORED} group by 1),
q as (select s.analysis_id, sloc, coalesce(d, 0) duplicated_lines, case when sloc > 0 then round(least(100.0::double, coalesce(d, 0) / sloc::double * 100.0::double), 2) else 0.0 end duplication_ratio, coalesce(b, 0) blocks from s left join d using (analysis_id) left join b using (analysis_id))
select *, round(greatest(0, least(100, 100 - duplication_ratio * 1.5::double - least(10, blocks * 0.5::double))), 1) duplication_score from q""",
    "duplicate_listing": f"""with w as (select j.id analysis_id, j.commit_hash, r.url from {_JOBS} j join repositories r on r.id = j.repository_id)
select d.id, d.analysis_id, d.line_count, regexp_replace(url, '/+$', '') || '/blob/' || commit_hash || '/' || sp || '#L' || source_start_line || '-L' || source_end_line source_url,
  regexp_replace(url, '/+$', '') || '/blob/' || commit_hash || '/' || tp || '#L' || target_start_line || '-L' || target_end_line target_url from {_DUP} d left join w using (analysis_id) where clone_type = 'TYPE_1'""",
    "clone_containment": f"""with b as (select distinct analysis_id, sp, tp, source_start_line ss, source_end_line se, target_start_line ts, target_end_line te, line_count lc from {_DUP}),
r as (select *, row_number() over (partition by analysis_id, sp, tp order by ss, ts, lc desc) k from b)
select analysis_id, sp source_file_path, tp target_file_path, ss source_start_line, ts target_start_line, lc line_count from r a where not exists
  (select 1 from r o where o.analysis_id = a.analysis_id and o.sp = a.sp and o.tp = a.tp and o.k < a.k and o.ss <= a.ss and o.se >= a.se and o.ts <= a.ts and o.te >= a.te)""",
    "churn_by_file": f"""with n as {_NUMSTAT}, c as (select path, count(distinct "commit") commit_count, greatest(1, count(distinct author)) author_count, cast(sum(added) as bigint) insertions, cast(sum(deleted) as bigint) deletions from n group by 1)
select *, round(greatest(0, least(100, commit_count / 20.0::double * 50.0::double + (insertions + deletions) / 1000.0::double * 30.0::double + author_count / 5.0::double * 20.0::double)), 1) churn_score from c""",
    "churn_summary": f"""with n as (select c_mktsegment grp, n.* from {_NUMSTAT} n join customer on c_custkey = author), c as (select grp, path, count(distinct "commit") cc, greatest(1, count(distinct author)) ac, sum(added) + sum(deleted) ln from n group by 1, 2),
m as (select grp, count(*) f, max(round(greatest(0, least(100, cc / 20.0::double * 50.0::double + ln / 1000.0::double * 30.0::double + ac / 5.0::double * 20.0::double)), 1)) mx from c group by 1), g as (select distinct c_mktsegment grp from customer union select 'none')
select grp, coalesce(f, 0) files, coalesce(mx, 0.0) max_churn, f is not null has_git_history from g left join m using (grp)""",
    "defect_scores": f"""with n as {_NUMSTAT}, c as (select path, count(distinct "commit") cc, greatest(1, count(distinct author)) ac, sum(added) + sum(deleted) ln from n group by 1),
s as (select path, round(greatest(0, least(100, cc / 20.0::double * 50.0::double + ln / 1000.0::double * 30.0::double + ac / 5.0::double * 20.0::double)), 1) churn_score from c),
p as (select 'src/part_' || p_partkey || '.py' path, round(greatest(0, least(100, p_size * 10 / 1000.0::double * 40.0::double + p_size % 20 / 20.0::double * 40.0::double + p_size % 5 / 5.0::double * 20.0::double)), 1) static_score from part)
select path, path < 'src/part_2' has_git_history, static_score, churn_score, case when path < 'src/part_2' then round(static_score * 0.6::double + coalesce(churn_score, 0.0::double) * 0.4::double, 1) else static_score end defect_score from p left join s using (path)""",
    "numstat_parsed": f"select * from {_NUMSTAT}",
    "fan_in_out": f"with {_DEGREE} select * from g",
    "top_fan_in": f"with {_DEGREE} select * from (select analysis_id, cast(row_number() over (partition by analysis_id order by fan_in desc, node) as int) \"position\", node, fan_in from g where fan_in > 0) where \"position\" <= 10",
    "graph_summary": f"""with {_DEGREE} select analysis_id, count(*) nodes, round(avg(fan_in), 2) avg_fan_in, round(avg(fan_out), 2) avg_fan_out, max(fan_in) max_fan_in, max(fan_out) max_fan_out, round(coalesce(avg(instability) filter (fan_in + fan_out > 0), 0), 2) avg_instability,
  count(*) filter (fan_in + fan_out = 0) isolated, count(*) filter (fan_in >= 3 and instability <= 0.3) core_foundation, count(*) filter (fan_out >= 5 or (fan_in >= 3 and fan_out >= 3)) high_coupling from g group by 1""",
    "graph_view": f"""with {_DEGREE}, t as (select analysis_id, node from (select *, row_number() over (partition by analysis_id order by fan_in + fan_out desc, node) k from g) where k <= 60)
select e.analysis_id, e.src, e.dst from e join t a on a.analysis_id = e.analysis_id and a.node = e.src join t b on b.analysis_id = e.analysis_id and b.node = e.dst""",
    "elementary_cycles": _CYCLES + "select g analysis_id, cap_reached, cast(cycle_id as int) cycle_id, cast(len(path) as int) length, array_to_string(path, '>') nodes from c",
    "cycle_membership": _CYCLES + "select g analysis_id, node, cast(sum(case when l = 1 then 2 else 1 end) as bigint) cycle_count from (select g, unnest(path) node, len(path) l from c) group by g, node",
    "cycle_edges": _CYCLES + "select g analysis_id, cast(cycle_id as int) cycle_id, cast(i - 1 as int) \"position\", path[i] src, path[case when i = len(path) then 1 else i + 1 end] dst from (select *, unnest(range(1, len(path) + 1)) i from c)",
    "clone_components": f"""with recursive e as {_EDGES}, r(g, x, y) as (select analysis_id, src, dst from e union select r.g, r.x, e.dst from r join e on e.analysis_id = r.g and e.src = r.y),
n as (select analysis_id g, src x from e union select analysis_id, dst from e), c as (select n.g, n.x, least(n.x, coalesce(min(r.y), n.x)) c, bool_or(r.y = n.x) loops from n left join (select r.* from r join r q on q.g = r.g and q.x = r.y and q.y = r.x) r on r.g = n.g and r.x = n.x group by 1, 2)
select g analysis_id, x node, c component, cast(count(*) over (partition by g, c) as int) members, coalesce(loops, false) "cyclic" from c""",
    "impact_dependents": _impact("dst", "src"),
    "impact_dependencies": _impact("src", "dst"),
    "folder_rollup": f"""
with f as (select analysis_id, p path, coalesce(sloc, 0) sloc, coalesce(max_cyclomatic_complexity, 0) cc, coalesce(issues_count, 0) issues, case when blocker_count > 0 then 0 when critical_count > 0 then 1 when major_count > 0 then 2 when minor_count > 0 then 3 else 5 end sev, string_split(p, '/') parts from {_SCORED}),
x as (select analysis_id, unnest(range(0, len(parts) + 1)) d, parts, sloc, cc, issues, sev from f),
y as (select analysis_id, case when d = 0 then '' else array_to_string(parts[1:d], '/') end path, d, d = len(parts) leaf, sloc, cc, issues, sev from x),
g as (select analysis_id, path, d, max(leaf::int) leaf, count(*) file_count, cast(sum(sloc) as bigint) sloc, cast(sum(cc) as bigint) total_cc, max(cc) max_cc, cast(sum(issues) as bigint) issues, min(sev) sev from y group by 1, 2, 3),
h as (select *, case when d > 0 then regexp_replace(path, '/?[^/]*$', '') end parent from g)
select analysis_id, path, parent, cast(d as int) as "depth", leaf = 1 is_file, file_count, sloc, total_cc, max_cc, issues, ['blocker', 'critical', 'major', 'minor', 'info'][sev + 1] dominant_severity,
  case when d > 0 then cast(row_number() over (partition by analysis_id, parent order by sloc desc, path) as int) else 0 end as "position" from h""",
    "sarif_rows": f"""select analysis_id, id, rule_id "rule", case when severity in ('blocker', 'critical') then 'error' when severity = 'major' then 'warning' else 'note' end as "level",
  regexp_replace(replace(coalesce(file_path, ''), '\\', '/'), '^/+', '') uri, case when line_number >= 1 then line_number else 0 end start_line from analysis_issues""",
    "version_mentions": """with l as (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) line from documents where text is not null)
select doc_id, cast(line as int) line from (select doc_id, line, unnest(regexp_extract_all(s, 'v[0-9]+[.][0-9]+[.][0-9]+')) v from l)""",
}
_PAIRS = "(select id head_id, base_id from (select id, base_analysis_id base_id, row_number() over (partition by id order by updated_at desc) n from analysis_jobs where base_analysis_id is not null) where n = 1)"
_LIFE = f"""i as (select * from (select analysis_id, fingerprint, severity, row_number() over (partition by analysis_id, fingerprint order by created_at desc nulls last, id desc nulls last, severity desc nulls last) n from (select *, {_PRINT} fingerprint from analysis_issues)) where n = 1), p as {_PAIRS},
h as (select head_id, fingerprint, severity hs from i join p on analysis_id = head_id), b as (select head_id, fingerprint, severity bs from i join p on analysis_id = base_id),
z as (select head_id, fingerprint, hs, bs, case when bs is null then 'new' when hs is null then 'fixed' else 'persistent' end lifecycle from b full join h using (head_id, fingerprint))"""
_FIG = f"""s as (select analysis_id, cast(sum(coalesce(sloc, 0)) as bigint) sloc, count(*) filter (max_cyclomatic_complexity >= 20) cf from {_SCORED} group by 1),
q as (select analysis_id, count(*) filter (severity = 'blocker') blocker, count(*) filter (severity = 'critical') critical, count(*) filter (severity = 'major') major, count(*) filter (severity = 'minor') minor, count(*) filter (severity = 'info') info,
  cast(sum(remediation_effort_minutes) as bigint) debt_minutes, count(*) filter (severity = 'blocker' and category in ('hygiene', 'security')) * 25.0::double + count(*) filter (severity = 'critical' and category in ('hygiene', 'security')) * 12.0::double
  + count(*) filter (severity = 'major' and category in ('hygiene', 'security')) * 5.0::double + count(*) filter (severity = 'minor' and category in ('hygiene', 'security')) * 1.5::double w from analysis_issues group by 1),
v as (select q.*, coalesce(sloc, 0) sloc, coalesce(cf, 0) cf from q left join s using (analysis_id)),
y as (select *, round(debt_minutes / 60.0::double / greatest(0.1::double, sloc / 1000.0::double), 1) debt_ratio, round(greatest(0, least(100, 100 - least(100, w / greatest(1.0::double, sqrt(sloc / 1000.0::double))))), 1) hygiene_score from v)"""
SQL |= {
    "issue_lifecycle": f"with {_LIFE} select head_id, fingerprint, lifecycle from z",
    "issue_debt": f"""with {_FIG} select analysis_id, sloc, blocker, critical, major, minor, info, debt_minutes, debt_ratio, hygiene_score,
  case when hygiene_score >= 95 then 'A+' when hygiene_score >= 90 then 'A' when hygiene_score >= 80 then 'B' when hygiene_score >= 70 then 'C' when hygiene_score >= 60 then 'D' else 'F' end grade from y""",
    "quality_gate": f"""with {_FIG}, u as (select analysis_id, [case when hygiene_score < 80 then 'overall_score' end, case when blocker > 0 then 'blocker_issues' end, case when critical > 2 then 'critical_issues' end, case when cf > 3 then 'critical_functions' end] a from y),
t as (select analysis_id, [x for x in a if x is not null] m from u)
select analysis_id, case when list_contains(m, 'overall_score') or list_contains(m, 'blocker_issues') then 'FAILED' when len(m) > 0 then 'WARNING' else 'PASSED' end status,
  not (list_contains(m, 'overall_score') or list_contains(m, 'blocker_issues')) passed, array_to_string(m, ',') missed from t""",
    "language_shares": f"""with d as ({SQL['discovered_files']}), p as (select analysis_id, "language", cast(sum(greatest(line_count, 0)) as bigint) lines, count(*) files from d where is_analyzable group by 1, 2),
w as (select analysis_id, sum(lines) al, sum(files) af from p group by 1)
select analysis_id, "language", lines, files, round(case when al > 0 then lines / al::double else files / af::double end * 100, 1) "share" from p join w using (analysis_id) where lines > 0 or al = 0""",
}
SQL |= {
    "file_metric_page": f"""select analysis_id, p file_path, sloc, max_cyclomatic_complexity from {_SCORED} where max_cyclomatic_complexity >= 10 and issues_count > 0
  order by max_cyclomatic_complexity desc nulls last, sloc desc nulls last, analysis_id, p limit 50 offset 50""",
    "churn_page": f"select path, churn_score, commit_count from ({SQL['churn_by_file']}) order by churn_score desc, commit_count desc, path limit 100",
    "score_timeline": f"""with {_FIG}, j as (select j.repository_id, j.id, coalesce(hygiene_score, 100.0) overall_score, commit_date, created_at from {_JOBS} j left join y on y.analysis_id = j.id where status = 'completed')
select repository_id, id, cast(row_number() over w as int) "position", overall_score, coalesce(round(overall_score - lag(overall_score) over w, 1), 0.0) delta, round(overall_score - first_value(overall_score) over w, 1) since_first
from j window w as (partition by repository_id order by commit_date nulls last, created_at nulls last, id)""",
    "repository_upsert": "select url, owner, name from repositories union select url || '-fork', owner, name || '-fork' from repositories",
    "redacted_messages": """select id, message line from analysis_jobs where message is not null union select id, error_message from analysis_jobs where error_message is not null
  union select id, 'fetch ' || regexp_replace(url, '^https://', 'https://***:***@') || ' with Token: ***' from repositories""",
    "event_messages": """select cast(user_id as varchar) as "key", '{"event":"' || event_type || '","data":{"event_id":' || event_id || '}}' as "value" from events""",
}
_STORED = f"""({SQL['issue_debt']}), sd as ({SQL['duplication_scores']}),
st as (select coalesce(sh.analysis_id, sd.analysis_id) id, coalesce(hygiene_score, 100.0) h, coalesce(duplication_score, 100.0) d, coalesce(debt_minutes, 0) m from sh full join sd on sh.analysis_id = sd.analysis_id),
so as (select *, round(greatest(0, least(100, (100.0::double + 100.0::double + 100.0::double + h) * 0.22::double + d * 0.12::double)), 1) o from st),
sp as {_PAIRS}, sx as (select p.head_id, p.base_id, round(coalesce(a.o, 100.0) - coalesce(b.o, 100.0), 1) overall, round(coalesce(a.h, 100.0) - coalesce(b.h, 100.0), 1) hygiene, round(coalesce(a.d, 100.0) - coalesce(b.d, 100.0), 1) duplication, coalesce(a.m, 0) - coalesce(b.m, 0) debt_minutes
  from sp p left join so a on a.id = p.head_id left join so b on b.id = p.base_id)"""
_CYCLE_LIFE = f"""pe as (select distinct analysis_id, src, dst from {_EDGES} where src <> dst), pc as (select distinct a.analysis_id, least(a.src, a.dst) || '>' || greatest(a.src, a.dst) "cycle" from pe a join pe b on b.analysis_id = a.analysis_id and b.src = a.dst and b.dst = a.src),
pp as {_PAIRS}, ph as (select head_id, "cycle", true h from pc join pp on analysis_id = head_id), pb as (select head_id, "cycle", true b from pc join pp on analysis_id = base_id),
pl as (select head_id, "cycle", case when b is null then 'new' when h is null then 'fixed' else 'persistent' end lifecycle from pb full join ph using (head_id, "cycle"))"""
SQL |= {
    "score_deltas": f"with sh as {_STORED} select * from sx",
    "pair_lifecycle": f"with {_CYCLE_LIFE} select * from pl",
    "comparisons": f"""select p.head_id, p.base_id, case when p.head_id = p.base_id then 'same run' when b.status is null then 'no base run' when h.status is null then 'no head run' when b.status <> 'completed' then 'base run not completed'
  when h.status <> 'completed' then 'head run not completed' when h.repository_id <> b.repository_id then 'other repository' end error from {_PAIRS} p left join {_JOBS} h on h.id = p.head_id left join {_JOBS} b on b.id = p.base_id""",
    "merge_verdicts": f"""with sh as {_STORED}, {_CYCLE_LIFE}, {_LIFE}, c as (select head_id, count(*) filter (lifecycle = 'new' and hs = 'blocker') new_blockers, count(*) filter (lifecycle = 'new' and hs = 'critical') new_criticals from z group by 1),
v as (select x.head_id, coalesce(new_blockers, 0) new_blockers, coalesce(new_criticals, 0) new_criticals, overall score_delta, coalesce(n, 0) new_cycles from sx x left join c using (head_id) left join (select head_id, count(*) filter (lifecycle = 'new') n from pl group by 1) using (head_id)),
w as (select *, [r for r in [case when new_blockers > 0 then 'new blocker issues' end, case when new_cycles > 0 then 'new circular dependencies' end, case when score_delta < -2 then 'score fell by more than 2' end] if r is not null] f,
  [r for r in [case when new_criticals > 0 then 'new critical issues' end, case when score_delta >= -2 and score_delta < 0 then 'score fell' end] if r is not null] g from v)
select head_id, new_blockers, new_criticals, score_delta, new_cycles, case when len(f) > 0 then 'FAILED' when len(g) > 0 then 'WARNING' else 'PASSED' end status, array_to_string(f || g, '; ') reasons from w""",
}
