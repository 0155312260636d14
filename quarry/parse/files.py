"""One pass over the files' contents, as a DataFrame operator; everything else reads its columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.parse import ecma_source, python_source
from quarry.session import spread
from quarry.sources.discovery import language_of

#: Parsers by language; more can be registered.
PARSERS: dict[str, Callable[[str, str], dict]] = {"Python": python_source.parse, "JavaScript": ecma_source.parse, "TypeScript": ecma_source.parse}

SYMBOL = "name string, symbol_type string, start_line int, start_column int, end_line int, end_column int, qualified_name string, parent_name string, signature string, has_docstring boolean, is_async boolean, mentions int"
FUNCTION = "name string, symbol_type string, start_line int, end_line int, lines_of_code int, cyclomatic_complexity int, nesting_depth int, parameter_count int, return_count int, branch_count int, loop_count int, exception_handler_count int, boolean_condition_count int"
IMPORT = "target_module string, dependency_type string, imported_symbols array<string>, line_number int, level int, is_type_only boolean"
HANDLER = "line_number int, exception_type string"
HIT = "name string, line_number int"
FIELDS = f"status string, error string, total_lines int, blank_lines int, comment_lines int, statement_count int, symbols array<struct<{SYMBOL}>>, functions array<struct<{FUNCTION}>>, imports array<struct<{IMPORT}>>, handlers array<struct<{HANDLER}>>, hits array<struct<{HIT}>>"


# Patterns of credentials and of calls that run text as code, with the languages they are looked for in.
SECRETS = {
    "AWS Access Key": r"\b(AKIA[0-9A-Z]{16})\b",
    "Private Key Header": r"-----BEGIN (?:RSA|EC|OPENSSH|DSA|PGP)?\s*PRIVATE KEY-----",
    "GitHub Token": r"\b(ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{82})\b",
    "Generic Secret Assignment": r"""(?i)(?:api_key|secret_key|auth_token|bearer_token)\s*=\s*['"][a-zA-Z0-9_\-\.]{24,}['"]""",
}
SINKS = {
    "eval": (r"\beval\s*\(", None), "exec": (r"\bexec\s*\(", ("Python",)), "Function": (r"\bnew\s+Function\s*\(", ("JavaScript", "TypeScript")), "dangerouslySetInnerHTML": (r"\bdangerouslySetInnerHTML\b", ("JavaScript", "TypeScript")),
}
_PATTERNS = [(n, re.compile(p, re.A), None) for n, p in SECRETS.items()] + [(n, re.compile(p, re.A), langs) for n, (p, langs) in SINKS.items()]


def hits(language: str | None, text: str) -> list[dict]:
    """Name and line of every match of the patterns that are looked for in this language."""
    out = []
    for name, pattern, languages in _PATTERNS:
        if languages is None or language in languages:
            line, at = 1, 0
            for m in pattern.finditer(text):
                line += text.count("\n", at, m.start())
                at = m.start()
                out.append({"name": name, "line_number": line})
    return out


def parse_one(language: str | None, path: str, text: str | None) -> dict:
    """Never raises: files of other languages are ``unsupported``, what a parser cannot read is ``failed``.

    ``hits`` are looked for in every text. ``mentions`` of a private function or method: how often its name occurs in the text.
    """
    empty = {"error": None, "total_lines": None, "blank_lines": 0, "comment_lines": 0, "statement_count": 0, "symbols": [], "functions": [], "imports": [], "handlers": []}
    parser = PARSERS.get(language or "")
    out = {"status": "unsupported"} | empty if parser is None or text is None else parser(path, text)
    out["hits"] = hits(language, text) if text else []
    for s in out["symbols"]:
        private = s["symbol_type"] in ("function", "method") and s["name"].startswith("_") and not s["name"].startswith("__")
        s["mentions"] = len(re.findall(rf"\b{re.escape(s['name'])}\b", text or "")) if private else None
    return out


def parse_files(files: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """``keys``, path, language and the parse results of every file. Contents go no further."""
    fields = T.StructType.fromDDL(FIELDS) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(FIELDS)
    schema = T.StructType([*[files.schema[k] for k in keys], T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), *fields.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            paths, languages = batch.column("path").to_pylist(), batch.column("language").to_pylist()
            rows = [parse_one(g, p or "", t) for p, g, t in zip(paths, languages, batch.column("content").to_pylist())]
            columns = [batch.column(k) for k in [*keys, "path", "language"]] + [pa.array([r[f.name] for r in rows], arrow.field(f.name).type) for f in fields.fields]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(columns)], schema=arrow)

    chosen = files.select(*keys, F.col(path).alias("path"), F.col(content).alias("content"), language_of(F.col(path)).alias("language"))
    return spread(chosen).mapInArrow(run, schema)


def explode_parts(parsed: DataFrame, keys: list[str], part: str) -> DataFrame:
    """One row per symbol, function, import or handler, with its ordinal."""
    return parsed.select(*keys, "path", "language", F.posexplode(part).alias("ordinal", "x")).select(*keys, "path", "language", "ordinal", "x.*")


def sloc() -> Column:
    return F.greatest(F.lit(0), F.coalesce("total_lines", F.lit(0)) - F.col("blank_lines") - F.col("comment_lines"))
