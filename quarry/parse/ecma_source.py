"""JavaScript and TypeScript files, by a token scan that follows brackets.

No syntax tree: declarations, bodies and imports are recognised by their tokens and bracket pairs. Limits: figures of
computed or unusual constructs (getters made by decorators, code in templates) follow their tokens only.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LEX = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<number>\b\d[\w.]*)|(?P<word>[^\W\d]\w*|[$#][\w$]*)|(?P<blank>\s+)"
    r"|(?P<sign>\?\?=|&&=|\|\|=|===|!==|\.\.\.|=>|\?\?|\?\.(?!\d)|&&|\|\||\*\*|[-+*/%]=|\+\+|--|.)",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
VALUE_END = {")", "]", "}", "word", "number", "string", "template"}
NOT_VALUES = frozenset("return typeof case in of delete void throw new else do instanceof await yield".split())
CONTROL = frozenset("if for while switch catch with".split())


class Tok(NamedTuple):
    kind: str
    text: str
    line: int
    column: int
    at: int
    end: int


def lex(text: str) -> list[Tok]:
    out: list[Tok] = []
    i, line, start, n = 0, 1, 0, len(text)
    last = ""
    while i < n:
        if text[i] == "`":
            j, depth = i + 1, 0
            while j < n and (depth or text[j] != "`"):
                if text[j] == "\\":
                    j += 1
                elif text.startswith("${", j):
                    depth += 1
                    j += 1
                elif depth and text[j] == "{":
                    depth += 1
                elif depth and text[j] == "}":
                    depth -= 1
                j += 1
            kind, e = "template", min(n, j + 1)
        elif text[i] == "/" and last not in VALUE_END and (m := REGEX.match(text, i)):
            kind, e = "string", m.end()
        else:
            m = LEX.match(text, i)
            kind, e = m.lastgroup, m.end()
        s = text[i:e]
        if kind not in ("comment", "blank"):
            out.append(Tok(kind, s, line, i - start, i, e))
            last = "" if kind == "word" and s in NOT_VALUES else s if kind == "sign" else kind
        breaks = s.count("\n")
        if breaks:
            line += breaks
            start = i + s.rindex("\n") + 1
        i = e
    return out


def pairs(tokens: list[Tok]) -> dict[int, int]:
    """Index of the partner of each bracket; the unpaired have none."""
    out, stack = {}, []
    for i, t in enumerate(tokens):
        if t.kind == "sign" and t.text in OPENERS:
            stack.append(i)
        elif t.kind == "sign" and t.text in CLOSERS:
            if stack and OPENERS[tokens[stack[-1]].text] == t.text:
                j = stack.pop()
                out[i], out[j] = j, i
    return out


def balanced(tokens: list[Tok], pair: dict[int, int]) -> bool:
    return all(i in pair for i, t in enumerate(tokens) if t.kind == "sign" and t.text in "()[]{}")


def line_classes(text: str) -> tuple[int, int, int]:
    """(total, blank, comment)."""
    from quarry.parse.python_source import lines_of

    blank = comment = 0
    inside = False
    lines = lines_of(text)
    for line in map(str.strip, lines):
        if inside:
            comment += 1
            inside = "*/" not in line
        elif not line:
            blank += 1
        elif line.startswith("//"):
            comment += 1
        elif line.startswith("/*"):
            comment += 1
            inside = "*/" not in line[2:]
    return len(lines), blank, comment


class _Functions:
    """Bodies of functions: (name, head index, open parenthesis or parameter, body start, body end, kind)."""

    def __init__(self, t: list[Tok], pair: dict[int, int]) -> None:
        self.t, self.pair = t, pair

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def body_after(self, i: int) -> tuple[int, int] | None:
        """The braces that follow a parameter list, past a return type."""
        j, n = i, len(self.t)
        if self.text(j) == ":":
            j += 1
            while j < n and self.text(j) not in ("{", ";", "=>"):
                j = self.pair.get(j, j) + 1 if self.text(j) in OPENERS else j + 1
            if self.text(j) == "{" and j in self.pair and self.text(self.pair[j] + 1) == "{":
                j = self.pair[j] + 1  # the type itself was in braces
        return (j, self.pair[j]) if self.text(j) == "{" and j in self.pair else None

    def all(self) -> list[dict]:
        t, pair, out = self.t, self.pair, []
        for i, tok in enumerate(t):
            if tok.text == "function" and tok.kind == "word" and self.text(i - 1) != ".":
                j = i + 1 + (self.text(i + 1) == "*")
                name = self.text(j) if j < len(t) and t[j].kind == "word" else None
                j += name is not None
                j = self.skip_generics(j)
                if self.text(j) == "(" and j in pair and (b := self.body_after(pair[j] + 1)):
                    plain = self.text(i - 1) not in ("=", "(", ",", ":", "return", "=>", "[", "?")
                    out.append({"name": name or self.assigned(i) or "anonymous", "head": i, "params": (j, pair[j]), "body": b, "kind": "declaration" if name and plain else "expression", "generator": self.text(i + 1) == "*"})
            elif tok.text == "=>":
                b = (i + 1, pair[i + 1]) if self.text(i + 1) == "{" and i + 1 in pair else (i + 1, self.expression_end(i + 1))
                if self.text(i - 1) == ")" and i - 1 in pair:
                    head = pair[i - 1]
                    params = (head, i - 1)
                else:
                    k = i - 1
                    while k > 0 and self.text(k) not in (")", "=", ",", "(", ";", "{", "}"):
                        k -= 1
                    if self.text(k) == ")" and k in pair and self.text(k + 1) == ":":
                        head, params = pair[k], (pair[k], k)
                    else:
                        head, params = i - 1, (i - 2, i)
                head -= self.text(head - 1) == "async"
                out.append({"name": self.assigned(head) or "anonymous", "head": head, "params": params, "body": b, "kind": "arrow", "generator": False})
            elif tok.text == "(" and i in pair and i and t[i - 1].kind in ("word", "string", "number") and t[i - 1].text not in CONTROL and self.text(i - 2) not in ("function", ".", "new", "?."):
                if self.text(i - 1) == "function" or (self.text(i - 2) == "*" and self.text(i - 3) == "function"):
                    continue
                if (b := self.body_after(pair[i] + 1)) and self.text(i - 1) not in NOT_VALUES and self.in_class_or_object(i):
                    out.append({"name": t[i - 1].text.strip("'\""), "head": i - 1, "params": (i, pair[i]), "body": b, "kind": "method", "generator": self.text(i - 2) == "*"})
        return out

    def skip_generics(self, j: int) -> int:
        if self.text(j) != "<":
            return j
        depth = 0
        while j < len(self.t):
            depth += (self.text(j) == "<") - (self.text(j) == ">")
            j += 1
            if not depth:
                break
        return j

    def in_class_or_object(self, i: int) -> bool:
        before = self.text(i - 2)
        return before in ("{", "}", ",", ";", "*", "async", "get", "set", "static", "public", "private", "protected", "readonly", "override", "abstract", ")") or self.t[i - 2].line < self.t[i - 1].line

    def assigned(self, i: int) -> str | None:
        """The name that a function expression is bound to: ``name =`` or ``name:`` before it."""
        j = i - 1 - (self.text(i - 1) == "async")
        if self.text(j) in ("=", ":") and j > 0:
            k = j - 1
            while k > 0 and self.text(k) not in ("const", "let", "var", ",", "{", ";", "}") and self.t[k].line == self.t[j].line:
                k -= 1
            first = k + (self.text(k) in ("const", "let", "var", ",", "{", ";", "}") or self.t[k].line != self.t[j].line)
            return self.t[first].text if first < j and self.t[first].kind == "word" else None
        return None

    def expression_end(self, i: int) -> int:
        """Last token of the expression that starts at i."""
        j, n = i, len(self.t)
        while j < n:
            s = self.text(j)
            if s in OPENERS and j in self.pair:
                j = self.pair[j]
            elif s in CLOSERS or s in (",", ";"):
                return j - 1
            if j + 1 < n and self.t[j + 1].line > self.t[j].line and self.text(j + 1) not in (".", "?", ":", "&&", "||", "??", "?.", "+", "-", "*", "/") and self.t[j].text not in ("=>", "?", ":", "&&", "||", "??", "+", "(", ",", "="):
                return j
            j += 1
        return n - 1


def _count_params(t: list[Tok], pair: dict[int, int], span: tuple[int, int]) -> int:
    a, b = span
    if b - a <= 1:
        return 0
    count, j, some = 0, a + 1, False
    while j < b:
        if t[j].text in OPENERS and j in pair:
            some, j = True, pair[j] + 1
            continue
        if t[j].text == "<":
            depth = 1
            while depth and j + 1 < b:
                j += 1
                depth += (t[j].text == "<") - (t[j].text == ">")
        if t[j].text == ",":
            count, some = count + some, False
        else:
            some = True
        j += 1
    return count + some


def _figures(t: list[Tok], pair: dict[int, int], fn: dict, nested: list[tuple[int, int]]) -> dict:
    a, b = fn["body"]
    f = {"cyclomatic_complexity": 1, "nesting_depth": 1, "return_count": 0, "branch_count": 0, "loop_count": 0, "exception_handler_count": 0, "boolean_condition_count": 0}
    inner = {x: y for x, y in nested if a < x and y <= b and (x, y) != (fn["head"], b)}
    deep: list[int] = []
    i = a
    while i <= b and i < len(t):
        if i in inner and i != a:
            i = max(i, inner[i]) + 1
            continue
        while deep and i > deep[-1]:
            deep.pop()
        tok = t[i]
        s, prev = tok.text, t[i - 1].text if i else ""
        word = tok.kind == "word" and prev not in (".", "?.")
        if word and s in ("if", "for", "while", "do", "switch", "try", "catch"):
            if s == "if":
                f["branch_count"] += 1
            elif s in ("for", "do") or (s == "while" and not (prev == "}" and _closes_do(t, pair, i - 1))):
                f["loop_count"] += 1
            elif s == "catch":
                f["exception_handler_count"] += 1
            j = i + 1
            if j < len(t) and t[j].text == "await":
                j += 1
            if j < len(t) and t[j].text == "(" and j in pair:
                j = pair[j] + 1
            if j < len(t) and t[j].text == "{" and j in pair:
                deep.append(pair[j])
                f["nesting_depth"] = max(f["nesting_depth"], len(deep) + 1)
            elif s != "catch":
                f["nesting_depth"] = max(f["nesting_depth"], len(deep) + 2)
        elif word and s == "case":
            f["branch_count"] += 1
        elif word and s == "return":
            f["return_count"] += 1
        elif s in ("&&", "||", "??", "&&=", "||=", "??="):
            f["boolean_condition_count"] += 1
        elif s == "?" and tok.kind == "sign" and i + 1 < len(t) and t[i + 1].text not in (":", ",", ")", ".", "]", "=", ";"):
            f["branch_count"] += 1
        i += 1
    f["cyclomatic_complexity"] += f["branch_count"] + f["loop_count"] + f["exception_handler_count"] + f["boolean_condition_count"]
    f["parameter_count"] = 1 if fn["params"][1] - fn["params"][0] == 2 and t[fn["params"][0] + 1].kind == "word" else _count_params(t, pair, fn["params"])
    first, last = t[fn["head"]], t[min(b, len(t) - 1)]
    f |= {"name": fn["name"], "symbol_type": "method" if fn["kind"] == "method" else "function", "start_line": first.line, "end_line": last.line + last.text.count("\n"), "lines_of_code": last.line + last.text.count("\n") - first.line + 1}
    return f


def _closes_do(t: list[Tok], pair: dict[int, int], i: int) -> bool:
    j = pair.get(i)
    return j is not None and j > 0 and t[j - 1].text == "do"


def _symbols(t: list[Tok], pair: dict[int, int], path: str, typed: bool, functions: list[dict]) -> list[dict]:
    """Top-level declarations and class members."""
    prefix = re.sub(r"\.[^./]*$", "", path.replace("\\", "/")).replace("/", ".")
    out: list[dict] = []

    def put(i: int, j: int, name: str, kind: str, parent: str | None = None, signature: str | None = None, is_async: bool = False) -> None:
        e = t[min(j, len(t) - 1)]
        out.append(
            {
                "name": name, "symbol_type": kind, "start_line": t[i].line, "start_column": t[i].column, "end_line": e.line + e.text.count("\n"), "end_column": e.column + len(e.text),
                "qualified_name": ".".join(x for x in (prefix, parent, name) if x), "parent_name": parent, "signature": signature, "has_docstring": False, "is_async": is_async,
            }
        )

    by_head = {f["head"]: f for f in functions}
    i, n = 0, len(t)
    while i < n:
        s = t[i].text
        start, exported = i, s == "export"
        if exported:
            i += 1
            if i < n and t[i].text == "default":
                i += 1
            s = t[i].text if i < n else ""
        while s in ("declare", "abstract") and i + 1 < n and t[i + 1].kind == "word":
            i += 1
            s = t[i].text
        is_async = s == "async"
        if is_async:
            i += 1
            s = t[i].text if i < n else ""
        end = i
        if s == "function" and i in by_head:
            f = by_head[i]
            end = f["body"][1]
            put(start, end, f["name"], "function", is_async=is_async)
        elif s == "class" and i + 1 < n:
            name = t[i + 1].text if t[i + 1].kind == "word" and t[i + 1].text != "extends" else "default"
            j = i + 1
            while j < n and t[j].text != "{":
                j += 1
            end = pair.get(j, n - 1)
            head = " ".join(x.text for x in t[i:j])
            put(start, end, name, "class", signature=head)
            for f in functions:
                if f["kind"] in ("method", "arrow") and j < f["head"] < end and _depth(t, pair, j, f["head"]) and (f["kind"] == "method"):
                    put(f["head"], f["body"][1], f["name"], "method", name, is_async=t[f["head"] - 1].text == "async")
        elif typed and s == "interface" and i + 1 < n:
            j = next((k for k in range(i, n) if t[k].text == "{"), n - 1)
            end = pair.get(j, n - 1)
            put(start, end, t[i + 1].text, "interface")
        elif typed and s in ("type", "enum") and i + 2 < n and t[i + 1].kind == "word":
            end = pair.get(i + 2, i + 2) if s == "enum" else _statement_end(t, pair, i)
            put(start, end, t[i + 1].text, "type")
        elif s in ("const", "let", "var") and i + 1 < n:
            if s == "const" and typed and t[i + 1].text == "enum":
                end = pair.get(i + 3, i + 3)
                put(start, end, t[i + 2].text, "type")
            else:
                end = _statement_end(t, pair, i)
                for f in functions:
                    if i < f["head"] <= end and f["kind"] in ("arrow", "expression") and f["name"] != "anonymous" and t[i + 1].text == f["name"]:
                        end = max(end, f["body"][1])
                        put(start, f["body"][1], f["name"], "function", is_async=t[f["head"]].text == "async")
                        break
        elif s == "import" and not exported:
            end = _statement_end(t, pair, i)
            names = [x.text for k, x in enumerate(t[i + 1 : end + 1], i + 1) if x.kind == "word" and x.text not in ("from", "type", "as") and t[k + 1 : k + 2] and t[k + 1].text != "as"]
            source = next((x.text[1:-1] for x in t[i : end + 1] if x.kind == "string"), "")
            put(start, end, ", ".join(names) or source, "import")
        elif s in OPENERS and i in pair:
            end = pair[i]
        if exported and end >= start:
            mine = [x["name"] for x in out if x["start_line"] == t[start].line and x["start_column"] == t[start].column]
            first = mine[0] if mine else (t[start + 1].text if start + 1 < n else "")
            put(start, max(end, start), f"export {first}", "export")
        i = max(i, end) + 1
    return out


def _depth(t: list[Tok], pair: dict[int, int], open_: int, i: int) -> bool:
    """Whether i lies directly within the brackets that open at ``open_``."""
    j = open_ + 1
    while j < i:
        j = max(j, pair[j]) + 1 if t[j].text in OPENERS and j in pair else j + 1
    return j == i


def _statement_end(t: list[Tok], pair: dict[int, int], i: int) -> int:
    j, n = i, len(t)
    while j < n:
        if t[j].text in OPENERS and j in pair:
            j = pair[j]
        if t[j].text == ";":
            return j
        if j + 1 < n and t[j + 1].line > t[j].line + t[j].text.count("\n") and (t[j].kind in ("word", "string", "number", "template") or t[j].text in CLOSERS) and t[j + 1].text not in (".", "?", ":", "=", "=>", "|", "&", "+", ",", "from", "&&", "||"):
            return j
        j += 1
    return n - 1


def _imports(t: list[Tok], pair: dict[int, int]) -> list[dict]:
    out = []

    def put(i: int, kind: str, module: str, names: list[str], type_only: bool = False) -> None:
        out.append({"target_module": module.strip("\"'`"), "dependency_type": kind, "imported_symbols": names or ["*"], "line_number": t[i].line, "level": 0, "is_type_only": type_only})

    for i, tok in enumerate(t):
        if tok.kind != "word" or (i and t[i - 1].text in (".", "?.")):
            continue
        nxt = t[i + 1].text if i + 1 < len(t) else ""
        if tok.text in ("require", "import") and nxt == "(":
            if i + 2 < len(t) and t[i + 2].kind in ("string", "template"):
                put(i, "require" if tok.text == "require" else "dynamic_import", t[i + 2].text, [])
        elif tok.text in ("import", "export"):
            end = _statement_end(t, pair, i)
            where = next((k for k in range(i + 1, end) if t[k].text == "from" and t[k + 1].kind == "string"), None)
            if where is not None:
                names = [x.text for k, x in enumerate(t[i + 1 : where], i + 1) if x.kind == "word" and x.text not in ("as", "type") and t[k + 1].text != "as"]
                put(i, "import" if tok.text == "import" else "re_export", t[where + 1].text, names, nxt == "type")
            elif tok.text == "import" and i + 1 < len(t) and t[i + 1].kind == "string":
                put(i, "import", t[i + 1].text, [])
    return sorted(out, key=lambda d: (d["line_number"], d["target_module"]))


EMPTY_CATCH = re.compile(r"catch\s*\([^)]*\)\s*\{\s*\}")


def parse(path: str, text: str) -> dict:
    total, blank, comment = line_classes(text)
    out = {"status": "parsed", "error": None, "total_lines": total, "blank_lines": blank, "comment_lines": comment, "statement_count": 0, "symbols": [], "functions": [], "imports": [], "handlers": []}
    if not text.strip():
        return out
    try:
        t = lex(text)
        pair = pairs(t)
        scan = _Functions(t, pair)
        functions = scan.all()
        spans = [(f["head"], f["body"][1]) for f in functions if not (f["kind"] == "expression" or f["generator"])]
        out["functions"] = [_figures(t, pair, f, spans) for f in functions]
        out["symbols"] = _symbols(t, pair, path, path.endswith((".ts", ".tsx", ".mts", ".cts")), functions)
        out["imports"] = _imports(t, pair)
        out["handlers"] = [{"line_number": text.count("\n", 0, m.start()) + 1, "exception_type": "catch"} for m in EMPTY_CATCH.finditer(text)]
        out["statement_count"] = sum(x.text == ";" for x in t)
        if t and not pair and not balanced(t, pair):
            out |= {"status": "failed", "error": "no bracket closes"}
    except (RecursionError, IndexError, KeyError, ValueError) as e:
        out |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
    return out
