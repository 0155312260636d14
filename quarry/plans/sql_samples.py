"""Expected rows of the sample queries: the operators' output, checked by hand against the rules that they follow."""


def _rows(columns: str, values: str) -> str:
    """SQL of the given rows. ``columns``: name and type of each."""
    pairs = [c.split() for c in columns.split(", ")]
    names = ", ".join(f'"{n}"' for n, _ in pairs)
    return f"select {', '.join(f'cast("{n}" as {t}) "{n}"' for n, t in pairs)} from (values {values}) v({names})"


SQL = {
    "sample_files": _rows(
        "path varchar, language varchar, status varchar, error varchar, total_lines int, blank_lines int, comment_lines int, symbols int, functions int",
        """
        ('notes.md', 'Markdown', 'unsupported', '', -1, 0, 0, 0, 0),
        ('src/broken.py', 'Python', 'failed', 'SyntaxError', 2, 0, 0, 0, 0),
        ('src/empty.py', 'Python', 'parsed', '', 2, 2, 0, 0, 0),
        ('src/figures.py', 'Python', 'parsed', '', 40, 9, 0, 6, 6),
        ('src/pay.py', 'Python', 'parsed', '', 21, 6, 2, 8, 4),
        ('src/risks.py', 'Python', 'parsed', '', 11, 2, 0, 1, 1),
        ('web/calc.js', 'JavaScript', 'parsed', '', 39, 4, 0, 7, 4),
        ('web/handler.js', 'JavaScript', 'parsed', '', 7, 0, 0, 1, 1),
        ('web/types.ts', 'TypeScript', 'parsed', '', 13, 3, 0, 8, 1)
        """,
    ),
    "sample_symbols": _rows(
        "path varchar, name varchar, symbol_type varchar, parent_name varchar, linked boolean, start_line int, end_line int, has_docstring boolean, is_async boolean",
        """
        ('src/pay.py', 'Depends', 'import', '', false, 3, 3, false, false),
        ('src/pay.py', 'PayService', 'class', '', false, 7, 14, true, false),
        ('src/pay.py', '__init__', 'method', 'PayService', true, 10, 11, false, false),
        ('src/pay.py', 'inner', 'method', 'total', true, 19, 20, false, false),
        ('src/pay.py', 'os', 'import', '', false, 1, 1, false, false),
        ('src/pay.py', 'pay', 'method', 'PayService', true, 13, 14, false, true),
        ('src/pay.py', 'system', 'import', '', false, 2, 2, false, false),
        ('src/pay.py', 'total', 'function', '', false, 17, 21, true, false),
        ('web/calc.js', 'React, useState', 'import', '', false, 1, 1, false, false),
        ('web/calc.js', 'Till', 'class', '', false, 14, 21, false, false),
        ('web/calc.js', 'calc', 'function', '', false, 3, 8, false, false),
        ('web/calc.js', 'charge', 'method', 'Till', true, 15, 20, false, true),
        ('web/calc.js', 'pick', 'function', '', false, 23, 39, false, false),
        ('web/calc.js', 'twice', 'function', '', false, 10, 12, false, false),
        ('web/types.ts', 'Role', 'type', '', false, 7, 9, false, false),
        ('web/types.ts', 'Status', 'type', '', false, 5, 5, false, false),
        ('web/types.ts', 'User', 'interface', '', false, 1, 3, false, false),
        ('web/types.ts', 'check', 'function', '', false, 11, 13, false, false)
        """,
    ),
    "sample_names": _rows(
        "name varchar, qualified_name varchar, signature varchar",
        """
        ('Depends', 'fastapi.Depends', ''),
        ('PayService', 'src.pa.PayService', 'class PayService(Base)'),
        ('__init__', 'src.pa.PayService.__init__', 'def __init__(self, key: str)'),
        ('inner', 'src.pa.total.inner', 'def inner(x)'),
        ('os', 'os', ''),
        ('pay', 'src.pa.PayService.pay', 'async def pay(self, amount: float = 1.5, *rest, **more) -> bool'),
        ('system', 'sys', ''),
        ('total', 'src.pa.total', 'def total(items: list) -> int')
        """,
    ),
    "sample_functions": _rows(
        "path varchar, name varchar, lines_of_code int, cyclomatic_complexity int, parameter_count int, return_count int, branch_count int, loop_count int, exception_handler_count int, boolean_condition_count int",
        """
        ('src/figures.py', 'add', 2, 1, 2, 1, 0, 0, 0, 0),
        ('src/figures.py', 'drain', 9, 4, 1, 1, 0, 2, 1, 0),
        ('src/figures.py', 'evens', 6, 5, 1, 1, 4, 0, 0, 1),
        ('src/figures.py', 'grade', 7, 5, 3, 3, 2, 0, 0, 2),
        ('src/figures.py', 'inner', 3, 2, 0, 0, 1, 0, 0, 0),
        ('src/figures.py', 'outer', 8, 2, 0, 1, 1, 0, 0, 0),
        ('web/calc.js', 'calc', 6, 2, 2, 2, 1, 0, 0, 0),
        ('web/calc.js', 'charge', 6, 3, 2, 1, 1, 0, 0, 1),
        ('web/calc.js', 'pick', 17, 5, 1, 1, 3, 1, 0, 0),
        ('web/calc.js', 'twice', 3, 1, 1, 1, 0, 0, 0, 0)
        """,
    ),
    "sample_matches": _rows(
        "name varchar, gap int",
        """
        ('add', 0),
        ('drain', 0),
        ('evens', 0),
        ('grade', 0),
        ('inner', 0),
        ('outer', 0)
        """,
    ),
    "sample_file_figures": _rows(
        "path varchar, total_lines int, sloc int, function_count int, class_count int, method_count int, import_count int, total_cyclomatic_complexity int, average_cyclomatic_complexity double, max_cyclomatic_complexity int, metric_status varchar, full_score boolean",
        """
        ('notes.md', 0, 0, 0, 0, 0, 0, 0, 1.0, 1, 'unsupported', true),
        ('src/broken.py', 2, 2, 0, 0, 0, 0, 0, 1.0, 1, 'failed', true),
        ('src/empty.py', 2, 0, 0, 0, 0, 0, 0, 1.0, 1, 'calculated', false),
        ('src/figures.py', 40, 31, 6, 0, 1, 0, 19, 3.17, 5, 'calculated', false),
        ('src/pay.py', 21, 13, 4, 1, 3, 3, 4, 1.0, 1, 'calculated', false),
        ('src/risks.py', 11, 9, 1, 0, 0, 0, 2, 2.0, 2, 'calculated', false),
        ('web/calc.js', 39, 35, 4, 1, 1, 1, 11, 2.75, 5, 'calculated', false),
        ('web/handler.js', 7, 7, 1, 0, 0, 0, 2, 2.0, 2, 'calculated', false),
        ('web/types.ts', 13, 10, 1, 0, 0, 0, 1, 1.0, 1, 'calculated', false)
        """,
    ),
    "sample_repository": _rows(
        "run varchar, files bigint, total_lines bigint, functions bigint, average_cc double, max_cc int, cc_low bigint, cc_moderate bigint, cc_high bigint, cc_very_high bigint, rating varchar",
        """
        ('r1', 9, 135, 17, 2.29, 5, 17, 0, 0, 0, 'good')
        """,
    ),
    "sample_kinds": _rows(
        "symbol_type varchar, symbols bigint",
        """
        ('class', 1),
        ('export', 4),
        ('function', 2),
        ('import', 3),
        ('interface', 1),
        ('method', 3),
        ('type', 2)
        """,
    ),
    "sample_flags": _rows(
        "path varchar, name varchar, flag varchar, severity varchar, threshold double",
        """
        ('a.py', 'f', 'DEEP_NESTING', 'HIGH', 4.0),
        ('a.py', 'f', 'HIGH_BRANCH_COUNT', 'MEDIUM', 8.0),
        ('a.py', 'f', 'HIGH_PARAMETER_COUNT', 'MEDIUM', 5.0),
        ('a.py', 'f', 'VERY_HIGH_COMPLEXITY', 'CRITICAL', 20.0),
        ('a.py', 'f', 'VERY_LARGE_FUNCTION', 'HIGH', 100.0),
        ('a.py', 'g', 'HIGH_COMPLEXITY', 'HIGH', 10.0),
        ('a.py', 'g', 'VERY_LARGE_FUNCTION', 'HIGH', 100.0),
        ('b.py', 'h', 'HIGH_COMPLEXITY', 'HIGH', 10.0),
        ('b.py', 'h', 'LARGE_FUNCTION', 'MEDIUM', 50.0)
        """,
    ),
    "sample_file_flags": _rows(
        "path varchar, flag varchar, severity varchar, position int",
        """
        ('a.py', 'POOR_MAINTAINABILITY', 'HIGH', 5),
        ('a.py', 'VERY_HIGH_COMPLEXITY', 'CRITICAL', 1),
        ('a.py', 'VERY_LARGE_FILE', 'HIGH', 4),
        ('b.py', 'VERY_HIGH_COMPLEXITY', 'CRITICAL', 2),
        ('c.py', 'VERY_HIGH_COMPLEXITY', 'CRITICAL', 3)
        """,
    ),
    "sample_imports": _rows(
        "path varchar, target_module varchar, line_number int, dependency_type varchar, level int, is_type_only boolean, symbols varchar, resolution_status varchar, target_path varchar",
        """
        ('app/core/database.py', 'app.services.users', 1, 'import', 0, false, 'app.services.users', 'internal', 'app/services/users.py'),
        ('app/services/local.py', 'users', 1, 'from_import', 1, false, 'a', 'internal', 'app/services/users.py'),
        ('app/services/users.py', '', 6, 'from_import', 1, false, 'local', 'internal', 'app/services/local.py'),
        ('app/services/users.py', 'bottle', 7, 'import', 0, false, 'bottle', 'internal', 'bottle.py'),
        ('app/services/users.py', 'core.database', 5, 'from_import', 2, false, 'get_db', 'internal', 'app/core/database.py'),
        ('app/services/users.py', 'fastapi', 8, 'import', 0, false, 'fastapi', 'external', ''),
        ('app/services/users.py', 'gone', 9, 'from_import', 1, false, 'x', 'unresolved', ''),
        ('app/services/users.py', 'math', 3, 'from_import', 0, false, 'sqrt,pi', 'external', ''),
        ('app/services/users.py', 'os', 1, 'import', 0, false, 'os', 'external', ''),
        ('app/services/users.py', 'sys', 2, 'import', 0, false, 'system', 'external', ''),
        ('app/services/users.py', 'utils', 4, 'from_import', 1, false, 'helper', 'internal', 'app/services/utils.py'),
        ('bottle.py', 'bottle', 1, 'import', 0, false, 'bottle', 'internal', 'bottle.py'),
        ('src/index.ts', './components', 4, 're_export', 0, false, 'helper', 'internal', 'src/components/index.tsx'),
        ('src/index.ts', './lib/debug', 3, 'require', 0, false, '*', 'internal', 'src/lib/debug.js'),
        ('src/index.ts', './none', 7, 'import', 0, false, 'n', 'unresolved', ''),
        ('src/index.ts', './routes', 2, 'import', 0, false, 'get,p', 'internal', 'src/routes.ts'),
        ('src/index.ts', 'express', 1, 'import', 0, false, 'express', 'external', ''),
        ('src/index.ts', 'fs', 5, 'import', 0, true, 'R', 'external', ''),
        ('src/index.ts', 'node:path', 6, 'import', 0, false, 'z', 'external', '')
        """,
    ),
    "sample_import_counts": _rows(
        "path varchar, total bigint, internal bigint, external bigint, unresolved bigint",
        """
        ('', 19, 10, 7, 2),
        ('app/core/database.py', 1, 1, 0, 0),
        ('app/services/local.py', 1, 1, 0, 0),
        ('app/services/users.py', 9, 4, 4, 1),
        ('bottle.py', 1, 1, 0, 0),
        ('src/index.ts', 7, 3, 3, 1)
        """,
    ),
    "sample_import_cycles": _rows(
        "cycle_id int, length int, nodes varchar, cap_reached boolean",
        """
        (1, 2, 'app/core/database.py>app/services/users.py', false),
        (2, 2, 'app/services/local.py>app/services/users.py', false),
        (3, 1, 'bottle.py', false)
        """,
    ),
    "sample_degrees": _rows(
        "node varchar, fan_in bigint, fan_out bigint, instability double",
        """
        ('app/core/database.py', 1, 1, 0.5),
        ('app/services/local.py', 1, 1, 0.5),
        ('app/services/users.py', 2, 4, 0.6667),
        ('app/services/utils.py', 1, 0, 0.0),
        ('bottle.py', 2, 1, 0.3333),
        ('src/components/index.tsx', 1, 0, 0.0),
        ('src/index.ts', 0, 3, 1.0),
        ('src/lib/debug.js', 1, 0, 0.0),
        ('src/routes.ts', 1, 0, 0.0)
        """,
    ),
    "sample_dependency_listing": _rows(
        "source_path varchar, target_path varchar, line_number int",
        """
        ('app/services/local.py', 'app/services/users.py', 1),
        ('app/services/users.py', 'app/core/database.py', 5),
        ('app/services/users.py', 'app/services/local.py', 6),
        ('app/services/users.py', 'app/services/utils.py', 4)
        """,
    ),
    "sample_cycles": _rows(
        "grp varchar, cycle_id int, length int, nodes varchar, cap_reached boolean",
        """
        ('full', 1, 2, '0>1', true),
        ('full', 2, 3, '0>1>2', true),
        ('full', 3, 4, '0>1>2>3', true),
        ('full', 4, 5, '0>1>2>3>4', true),
        ('full', 5, 6, '0>1>2>3>4>5', true),
        ('loop', 1, 1, '1', false),
        ('pair', 1, 2, '1>2', false),
        ('pairs', 1, 2, '1>2', false),
        ('pairs', 2, 2, '3>4', false),
        ('three', 1, 3, '1>2>3', false)
        """,
    ),
    "sample_components": _rows(
        "grp varchar, node int, component int, members int, cyclic boolean",
        """
        ('chain', 1, 1, 1, false),
        ('chain', 2, 2, 1, false),
        ('chain', 3, 3, 1, false),
        ('loop', 1, 1, 1, true),
        ('pair', 1, 1, 2, true),
        ('pair', 2, 1, 2, true),
        ('pairs', 1, 1, 2, true),
        ('pairs', 2, 1, 2, true),
        ('pairs', 3, 3, 2, true),
        ('pairs', 4, 3, 2, true),
        ('three', 1, 1, 3, true),
        ('three', 2, 1, 3, true),
        ('three', 3, 1, 3, true)
        """,
    ),
    "sample_clones": _rows(
        "run varchar, clone_type int, source_file_path varchar, source_start_line int, source_end_line int, target_file_path varchar, target_start_line int, target_end_line int, line_count int",
        """
        ('r1', 1, 'a.py', 1, 16, 'b.py', 2, 17, 16),
        ('r1', 2, 'a.py', 1, 16, 'c.py', 1, 16, 16),
        ('r1', 2, 'b.py', 2, 17, 'c.py', 1, 16, 16)
        """,
    ),
    "sample_source_rules": _rows(
        "file_path varchar, rule_id varchar, severity varchar, line_number int, symbol_name varchar, remediation_effort_minutes int",
        """
        ('src/figures.py', 'MAINT-003', 'minor', 1, 'add', 15),
        ('src/figures.py', 'MAINT-003', 'minor', 14, 'drain', 15),
        ('src/figures.py', 'MAINT-003', 'minor', 25, 'evens', 15),
        ('src/figures.py', 'MAINT-003', 'minor', 33, 'outer', 15),
        ('src/figures.py', 'MAINT-003', 'minor', 5, 'grade', 15),
        ('src/risks.py', 'HYGIENE-001', 'major', 10, '', 30),
        ('src/risks.py', 'MAINT-003', 'minor', 5, 'run', 15),
        ('src/risks.py', 'SEC-001', 'blocker', 1, '', 60),
        ('src/risks.py', 'SEC-001', 'blocker', 2, '', 60),
        ('src/risks.py', 'SEC-002', 'blocker', 6, '', 60),
        ('src/risks.py', 'SEC-002', 'blocker', 7, '', 60),
        ('web/calc.js', 'MAINT-003', 'minor', 10, 'twice', 15),
        ('web/calc.js', 'MAINT-003', 'minor', 14, 'Till', 15),
        ('web/calc.js', 'MAINT-003', 'minor', 23, 'pick', 15),
        ('web/calc.js', 'MAINT-003', 'minor', 3, 'calc', 15),
        ('web/handler.js', 'HYGIENE-001', 'major', 4, '', 30),
        ('web/handler.js', 'MAINT-003', 'minor', 1, 'f', 15),
        ('web/handler.js', 'SEC-002', 'blocker', 7, '', 60),
        ('web/types.ts', 'MAINT-003', 'minor', 11, 'check', 15)
        """,
    ),
    "sample_graph_rules": _rows(
        "file_path varchar, rule_id varchar, severity varchar, line_number int, symbol_name varchar, remediation_effort_minutes int, severity_rank int",
        """
        ('a.py', 'ARCH-001', 'critical', 0, '', 120, 1),
        ('a.py', 'COMPLEX-001', 'critical', 1, 'c20', 90, 1),
        ('a.py', 'COMPLEX-002', 'major', 1, 'c11', 45, 2),
        ('a.py', 'COMPLEX-002', 'major', 1, 'c19', 45, 2),
        ('a.py', 'COMPLEX-003', 'major', 1, 'deep', 45, 2),
        ('a.py', 'COMPLEX-005', 'minor', 1, 'many', 30, 3),
        ('d12.py', 'DUP-001', 'minor', 1, '', 24, 3),
        ('d21.py', 'DUP-001', 'major', 1, '', 42, 2),
        ('d56.py', 'DUP-001', 'critical', 1, '', 112, 1),
        ('giant.py', 'COMPLEX-004', 'major', 0, '', 60, 2),
        ('giant.py', 'MAINT-002', 'major', 0, '', 45, 2),
        ('god.py', 'ARCH-002', 'major', 0, '', 90, 2),
        ('god.py', 'MAINT-001', 'critical', 0, '', 90, 1),
        ('hub.py', 'ARCH-003', 'major', 0, '', 90, 2),
        ('p.py', 'HYGIENE-002', 'minor', 1, '_dead', 20, 3),
        ('p.py', 'MAINT-003', 'minor', 1, 'open', 15, 3),
        ('small.py', 'MAINT-002', 'major', 0, '', 45, 2),
        ('still.py', 'ARCH-004', 'minor', 7, '', 45, 3)
        """,
    ),
    "sample_pillars": _rows(
        "run varchar, maintainability_score double, complexity_score double, architecture_score double, hygiene_score double, duplication_score double, overall_score double, grade varchar",
        """
        ('architecture', 100.0, 100.0, 65.3, 100.0, 100.0, 92.4, 'A'),
        ('blockers', 100.0, 100.0, 100.0, 0.0, 100.0, 78.0, 'C'),
        ('clean', 100.0, 100.0, 100.0, 100.0, 100.0, 100.0, 'A+'),
        ('complexity', 100.0, 64.5, 100.0, 100.0, 100.0, 92.2, 'A'),
        ('copies', 100.0, 100.0, 100.0, 100.0, 0.0, 88.0, 'B'),
        ('duplication', 100.0, 100.0, 100.0, 100.0, 82.0, 97.8, 'A+'),
        ('hygiene', 100.0, 100.0, 100.0, 56.5, 100.0, 90.4, 'A'),
        ('maintainability', 41.0, 100.0, 100.0, 100.0, 100.0, 87.0, 'B'),
        ('minor', 100.0, 100.0, 100.0, 98.5, 100.0, 99.7, 'A+')
        """,
    ),
    "sample_grades": _rows(
        "score double, grade varchar",
        """
        (0.0, 'F'),
        (59.9, 'F'),
        (60.0, 'D'),
        (69.9, 'D'),
        (70.0, 'C'),
        (79.9, 'C'),
        (80.0, 'B'),
        (89.9, 'B'),
        (90.0, 'A'),
        (94.9, 'A'),
        (95.0, 'A+')
        """,
    ),
    "sample_recommendations": _rows(
        "rank int, target varchar, gain double, effort bigint, issues bigint, rules varchar",
        """
        (1, 'a.py::f', 7.5, 90, 1, 'COMPLEX-001'),
        (2, 'a.py', 5.5, 60, 1, 'SEC-001'),
        (3, 'b.py', null, 90, 1, 'MAINT-001')
        """,
    ),
    "sample_gates": _rows(
        "run varchar, status varchar, passed boolean, missed varchar",
        """
        ('blocker', 'FAILED', false, 'blocker_issues'),
        ('criticals', 'WARNING', true, 'critical_issues'),
        ('cycle', 'FAILED', false, 'circular_dependencies'),
        ('functions', 'WARNING', true, 'critical_functions'),
        ('mi', 'WARNING', true, 'average_maintainability'),
        ('nothing', 'PASSED', true, ''),
        ('pass', 'PASSED', true, ''),
        ('score', 'FAILED', false, 'overall_score')
        """,
    ),
    "sample_verdicts": _rows(
        "run varchar, status varchar, reasons varchar",
        """
        ('blocker', 'FAILED', 'new blocker issues'),
        ('critical', 'WARNING', 'new critical issues'),
        ('cycle', 'FAILED', 'new circular dependencies'),
        ('limit', 'WARNING', 'score fell'),
        ('more', 'PASSED', ''),
        ('much', 'FAILED', 'score fell by more than 2'),
        ('same', 'PASSED', ''),
        ('some', 'WARNING', 'score fell')
        """,
    ),
    "sample_cycle_lifecycle": _rows(
        "cycle varchar, lifecycle varchar",
        """
        ('a>b>c', 'persistent'),
        ('p>q', 'new'),
        ('x>y', 'fixed')
        """,
    ),
    "sample_churn": _rows(
        "path varchar, commit_count bigint, author_count bigint, insertions bigint, deletions bigint, churn_score double",
        """
        ('logo.png', 1, 1, 0, 0, 6.5),
        ('main.py', 2, 2, 15, 6, 13.6),
        ('new.py', 1, 1, 3, 0, 6.6),
        ('utils.py', 1, 1, 20, 2, 7.2)
        """,
    ),
    "sample_treemap": _rows(
        "path varchar, x double, y double, w double, h double",
        """
        ('', 0.0, 0.0, 100.0, 100.0),
        ('a', 60.0, 0.0, 40.0, 100.0),
        ('a/x.py', 60.0, 0.0, 40.0, 75.0),
        ('a/y.py', 60.0, 75.0, 40.0, 25.0),
        ('b.py', 0.0, 0.0, 60.0, 100.0)
        """,
    ),
    "sample_treemap_means": _rows(
        "path varchar, maintainability double",
        """
        ('', 45.1),
        ('a', 62.6),
        ('a/x.py', 50.0),
        ('a/y.py', 75.25),
        ('b.py', 10.0)
        """,
    ),
    "sample_sarif": _rows(
        "version varchar, position int, rule varchar, level varchar, title varchar",
        """
        ('2.1.0', 0, 'A-1', 'note', 'None'),
        ('2.1.0', 1, 'A-1', 'error', 'First'),
        ('2.1.0', 2, 'B-1', 'warning', 'Late')
        """,
    ),
    "sample_redaction": _rows(
        "id varchar, line varchar",
        """
        ('bearer', 'Authorization: ***'),
        ('key', 'api_key = ''abc'', done'),
        ('null', null),
        ('plain', 'nothing here'),
        ('token', 'got *** now'),
        ('url', 'clone https://***:***@host/x failed')
        """,
    ),
}
