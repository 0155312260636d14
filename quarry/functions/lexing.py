"""Token streams of source files for clone detection and structure scans."""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from typing import NamedTuple

# Words that keep their text in a normalised stream.
SCRIPT_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void while with yield async await of from as type"
).split()
KEPT = frozenset(keyword.kwlist) | frozenset(SCRIPT_WORDS)


class Token(NamedTuple):
    text: str
    normal: str
    line: int


GENERIC = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<number>\b\d[\w.]*)|(?P<word>[^\W\d]\w*|\$\w*)|(?P<newline>\n)|(?P<blank>[^\S\n]+)|(?P<sign>===|!==|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|\.\.\.|.)",
    re.S,
)


def generic_tokens(text: str) -> list[Token]:
    """Any language with C-like comments. Names become _ID_, literals _LIT_; names of imports keep their text."""
    out, line, importing = [], 1, False
    for m in GENERIC.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "newline":
            importing = False
        elif kind not in ("comment", "blank"):
            if kind == "word":
                normal = s if s in KEPT or importing else "_ID_"
                importing = importing or s in ("import", "from")
            elif kind in ("string", "number"):
                normal = "_LIT_"
            else:
                normal = s
                importing = importing and s != ";"
            out.append(Token(s, normal, line))
        line += s.count("\n")
    return out


def python_tokens(text: str) -> list[Token]:
    """By the tokenizer of the interpreter; what it cannot read goes through the generic stream."""
    skipped = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING)
    out, importing = [], -1
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in skipped:
                continue
            line = t.start[0]
            if t.type == tokenize.NAME:
                normal = t.string if t.string in KEPT or importing == line else "_ID_"
                if t.string in ("import", "from"):
                    importing = line
            elif t.type in (tokenize.NUMBER, tokenize.STRING):
                normal = "_LIT_"
            else:
                normal = t.string
            out.append(Token(t.string, normal, line))
    except (tokenize.TokenError, IndentationError, SyntaxError, ValueError):
        return generic_tokens(text)
    return out


def tokens_of(path: str, text: str) -> list[Token]:
    return python_tokens(text) if path.endswith((".py", ".pyi")) else generic_tokens(text)
