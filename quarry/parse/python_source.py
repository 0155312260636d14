"""Python files, by the interpreter's own syntax trees."""

from __future__ import annotations

import ast
import re
import warnings

_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEEPER = (ast.If, ast.IfExp, *_LOOPS, ast.ExceptHandler, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
_LINE = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]")


def lines_of(text: str) -> list[str]:
    """Lines at every kind of line end; no empty last line."""
    parts = _LINE.split(text)
    return parts[:-1] if parts and parts[-1] == "" else parts


def line_classes(text: str) -> tuple[int, int, int]:
    """(total, blank, comment). Block strings that start a line count as comments."""
    blank = comment = 0
    open_quote = None
    lines = lines_of(text)
    for line in map(str.strip, lines):
        if open_quote:
            comment += 1
            if open_quote in line:
                open_quote = None
        elif not line:
            blank += 1
        elif line[0] == "#":
            comment += 1
        elif line[:3] in ('"""', "'''"):
            comment += 1
            if line.count(line[:3]) < 2:
                open_quote = line[:3]
    return len(lines), blank, comment


def module_name(path: str) -> str:
    """Dotted module of a path. Trailing letters of the suffix's alphabet go too, as in ``happy.py`` -> ``ha``."""
    return path.rstrip(".py").rstrip(".pyi").replace("\\", "/").replace("/", ".")


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    plain = len(a.args)
    shown = []
    for i, arg in enumerate(a.args):
        s = arg.arg + (f": {ast.unparse(arg.annotation)}" if arg.annotation else "")
        back = i - (plain - len(a.defaults))
        shown.append(s + (f" = {ast.unparse(a.defaults[back])}" if 0 <= back < len(a.defaults) else ""))
    shown += [f"*{a.vararg.arg}"] if a.vararg else []
    shown += [f"**{a.kwarg.arg}"] if a.kwarg else []
    out = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({', '.join(shown)})"
    return out + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def _symbols(tree: ast.Module, path: str) -> list[dict]:
    out: list[dict] = []

    def put(node: ast.AST, name: str, kind: str, qualified: str, parent: str | None, **more) -> None:
        out.append(
            {
                "name": name, "symbol_type": kind, "start_line": node.lineno, "start_column": node.col_offset, "end_line": node.end_lineno, "end_column": node.end_col_offset,
                "qualified_name": qualified, "parent_name": parent, "signature": more.get("signature"), "has_docstring": bool(more.get("doc")), "is_async": isinstance(node, ast.AsyncFunctionDef),
            }
        )

    def walk(node: ast.AST, prefix: str, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFS):
                q = f"{prefix}.{child.name}"
                put(child, child.name, "method" if parent else "function", q, parent, signature=_signature(child), doc=ast.get_docstring(child))
                walk(child, q, child.name)
            elif isinstance(child, ast.ClassDef):
                q = f"{prefix}.{child.name}"
                bases = ", ".join(map(ast.unparse, child.bases))
                put(child, child.name, "class", q, parent, signature=f"class {child.name}" + (f"({bases})" if bases else ""), doc=ast.get_docstring(child))
                walk(child, q, child.name)
            elif isinstance(child, ast.Import):
                for n in child.names:
                    put(child, n.asname or n.name, "import", n.name, parent)
            elif isinstance(child, ast.ImportFrom):
                for n in child.names:
                    put(child, n.asname or n.name, "import", f"{'.' * child.level}{child.module or ''}.{n.name}", parent)

    walk(tree, module_name(path), None)
    return out


def _figures(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    """Figures of a function's own code; nested definitions have their own."""
    f = {"cyclomatic_complexity": 1, "nesting_depth": 0, "return_count": 0, "branch_count": 0, "loop_count": 0, "exception_handler_count": 0, "boolean_condition_count": 0}
    negations = 0
    todo: list[tuple[ast.AST, int]] = [(child, 0) for child in ast.iter_child_nodes(fn)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, (*_DEFS, ast.ClassDef)):
            continue
        if isinstance(node, (ast.If, ast.IfExp)):
            f["branch_count"] += 1
        elif isinstance(node, _LOOPS):
            f["loop_count"] += 1
        elif isinstance(node, ast.ExceptHandler):
            f["exception_handler_count"] += 1
        elif isinstance(node, ast.BoolOp):
            f["boolean_condition_count"] += len(node.values) - 1
        elif isinstance(node, ast.Return):
            f["return_count"] += 1
        elif isinstance(node, ast.comprehension):
            f["branch_count"] += len(node.ifs)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            negations += 1  # a condition, but no further path
        if isinstance(node, _DEEPER):
            depth += 1
            f["nesting_depth"] = max(f["nesting_depth"], depth)
        todo += [(child, depth) for child in ast.iter_child_nodes(node)]
    f["cyclomatic_complexity"] += f["branch_count"] + f["loop_count"] + f["exception_handler_count"] + f["boolean_condition_count"]
    f["boolean_condition_count"] += negations
    a = fn.args
    f["parameter_count"] = len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
    f |= {"name": fn.name, "symbol_type": "function", "start_line": fn.lineno, "end_line": fn.end_lineno, "lines_of_code": (fn.end_lineno or fn.lineno) - fn.lineno + 1}
    return f


def _imports(tree: ast.Module) -> list[dict]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [{"target_module": n.name, "dependency_type": "import", "imported_symbols": [n.asname or n.name], "line_number": node.lineno, "level": 0, "is_type_only": False} for n in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append({"target_module": node.module or "", "dependency_type": "from_import", "imported_symbols": [n.name for n in node.names], "line_number": node.lineno, "level": node.level, "is_type_only": False})
    return sorted(out, key=lambda d: (d["line_number"], d["target_module"]))


def _swallowing(tree: ast.Module) -> list[dict]:
    """Handlers that do nothing: only ``pass`` or a lone string."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and len(node.body) == 1:
            only = node.body[0]
            if isinstance(only, ast.Pass) or (isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and isinstance(only.value.value, str)):
                out.append({"line_number": node.lineno, "exception_type": ast.unparse(node.type) if node.type else "Exception"})
    return sorted(out, key=lambda h: h["line_number"])


def parse(path: str, text: str) -> dict:
    total, blank, comment = line_classes(text)
    out = {"status": "parsed", "error": None, "total_lines": total, "blank_lines": blank, "comment_lines": comment, "statement_count": 0, "symbols": [], "functions": [], "imports": [], "handlers": []}
    if not text.strip():
        return out
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
        out |= {"symbols": _symbols(tree, path), "imports": _imports(tree), "handlers": _swallowing(tree)}
        nodes = list(ast.walk(tree))
        out["functions"] = sorted((_figures(n) for n in nodes if isinstance(n, _DEFS)), key=lambda f: (f["start_line"], f["name"]))
        out["statement_count"] = sum(isinstance(n, ast.stmt) + isinstance(n, (*_DEFS, ast.ClassDef)) for n in nodes)
    except SyntaxError as e:
        out |= {"status": "failed", "error": f"SyntaxError at line {e.lineno}: {e.msg}"}
    except (ValueError, RecursionError, MemoryError) as e:
        out |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
    return out
