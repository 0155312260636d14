"""Generated, minified, vendored and data files among source files.

Vendored copies: each file's token stream, without comments and spacing, is fingerprinted by winnowing (the smallest
hash of every window of hashes of ``GRAM`` tokens). A fingerprint that occurs in ``REPOSITORIES`` or more unrelated
repositories recurs; a file most of whose fingerprints recur is a copy, whatever its path, name or notice says. Files of every
suffix are fingerprinted, and copies come first: what is a copy needs no other kind. Repositories of one owner are
related and count once. Counting distinct owners is an aggregation over fingerprints that combines before the shuffle; no task
holds a fingerprint's files or a file's corpus, and fingerprints of very many files are joined without one task for each.

The other kinds show in the token stream or the opening comments: a tool's stamp; spacing of minified code; the share of
numbers, literals or encoded bytes; members numbered through. Ordinary JSON, YAML, Markdown, text and shell files are
data or text by nature, so of these only copies and stamped files count. What a file merely says in strings or in later text counts for nothing.

Defined results: null contents are no cases; empty and tiny files are hand-written; of repeated rows any flags the id.
A file of fewer than GRAM tokens has no fingerprint and is no copy.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import spread
from quarry.skew import hot_keys, join_one

#: Tokens in a fingerprinted gram, hashes in a winnowing window (a shared run of GRAM + WINDOW - 1 tokens shares a fingerprint).
GRAM, WINDOW = 48, 8
#: Unrelated repositories in which a fingerprint recurs; share of recurring fingerprints of a copy; fewest fingerprints that tell.
REPOSITORIES, SHARE, LEAST = 3, 0.6, 1

PLAIN_SUFFIXES = frozenset({"json", "yml", "yaml", "md", "markdown", "rst", "txt", "sh", "bash", "lock", "toml", "ini", "cfg"})
HASH_COMMENTS = frozenset({"py", "pyi", "rb", "sh", "yml", "yaml", "toml"})

TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\d[\w.]*|\S')
STRIP_C = re.compile(r'("(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`)|/\*.*?(?:\*/|\Z)|//[^\n]*', re.S)
STRIP_HASH = re.compile(r'("""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|#[^\n]*', re.S)

TOOL_STAMP = re.compile(
    r"(?i)\b(?:code|file|source|sources|class|stubs?)?\s*(?:is |was |has been )?(?:auto[- ]?)?generated (?:by|from|with|using|at|on)\b|@generated\b|\bauto-?generated\b|<auto-?generated|"
    r"\bautomatically (?:created|generated|produced|written|built) (?:by|from|with)\b|\bmachine[- ](?:written|generated|made|produced)\b|\bdo not (?:modify|edit|change|touch)\b[^\n]*\b(?:output of|generated|produced|created|regenerate)\b|"
    r"\b(?:changes|edits|modifications)\b[^\n]{0,40}\bwill be (?:lost|overwritten|discarded)\b|\bregenerated? (?:with|by|using|from|via)\b|\boutput of \w[\w-]*(?:gen|rpc|c|compiler)\b"
)
TOOL_NOT = re.compile(r"(?i)\bnot (?:auto[- ]?)?generated\b|\bby hand\b|\bhand-?written\b")
BASE64 = re.compile(r"[A-Za-z0-9+/=_\-]{60,}|(?:\\x[0-9a-fA-F]{2}){16,}|(?:0x[0-9a-fA-F]{1,2}\s*,\s*){16,}")
NUMBERED = re.compile(r"\b[A-Za-z_$]*[A-Za-z_](\d{1,4})\b|\['(\d{1,4})'\]")


def suffix(path: str | None) -> str:
    m = re.search(r"\.([^./\\]*)$", path or "")
    return m.group(1).lower() if m else ""


def header(text: str, hash_style: bool) -> str:
    """The comments that open a file, before any code. Bounded by the code's start, not by a count of characters."""
    out, i, n = [], 0, len(text)
    while i < n:
        m = re.compile(r"\s+").match(text, i)
        if m:
            i = m.end()
            continue
        if text.startswith("#", i) and (hash_style or text.startswith("#!", i)) or text.startswith("//", i):
            e = text.find("\n", i)
            e = n if e < 0 else e
        elif text.startswith("/*", i):
            e = text.find("*/", i)
            e = n if e < 0 else e + 2
        elif text.startswith("<!--", i):
            e = text.find("-->", i)
            e = n if e < 0 else e + 3
        else:
            break
        out.append(text[i:e])
        i = e
    return "\n".join(re.sub(r"^[\s/*#!<\-]*", "", line) for part in out for line in part.split("\n"))


def fingerprints(tokens: list[str]) -> np.ndarray:
    """Winnowed fingerprints of the stream, distinct, as longs."""
    n = len(tokens) - GRAM + 1
    if n <= 0:
        return np.array([], np.int64)
    codes = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens], np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[i : i + n] + np.uint64(i))
            h ^= h >> np.uint64(29)
    if n <= WINDOW:
        return np.array([h.min()]).view(np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(windows.min(1)).view(np.int64)


def inspect(path: str | None, text: str) -> tuple[str | None, list[str]]:
    """The kind that the file itself shows (generated, minified, data or None), and its tokens."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    kind = suffix(path)
    if not text.strip():
        return None, []
    hash_style = kind in HASH_COMMENTS
    head = header(text, hash_style)
    code = (STRIP_HASH if hash_style else STRIP_C).sub(lambda m: m.group(1) or " ", text)
    tokens = TOKEN.findall(code)
    if any(TOOL_STAMP.search(line) and not TOOL_NOT.search(line) for line in head.split("\n")):
        return "generated", tokens
    if kind in PLAIN_SUFFIXES:
        return None, tokens
    words = [t for t in tokens if t[0].isalnum() or t[0] in "_$\"'`"]
    numbers = sum(t[0].isdigit() for t in words)
    quoted = sum(len(t) for t in tokens if t[0] in "\"'`")
    size = sum(map(len, tokens)) or 1
    coded = sum(len(m.group()) for m in BASE64.finditer(code))
    if (numbers >= 8 and numbers >= 0.8 * len(words)) or (coded >= 60 and coded >= 0.6 * size):
        return "data", tokens
    literals = numbers + sum(t[0] in "\"'`" for t in words)
    if literals >= 40 and literals >= 0.85 * len(words):
        return "data", tokens
    lines = [x for x in code.split("\n") if x.strip()]
    if kind not in HASH_COMMENTS and size >= 40:
        bare = size - quoted
        blanks = sum(x.count(" ") + x.count("\t") for x in lines)
        if bare / max(1, len(lines)) >= 90 and blanks <= 0.16 * size:
            return "minified", tokens
    if kind != "css" and len(lines) >= 4:
        seen = [{int(a or b) for a, b in NUMBERED.findall(x)} for x in lines]
        marked = sum(map(bool, seen))
        top = set().union(*seen)
        if len(top) >= 4 and set(range(4)) <= top and (marked >= 0.55 * len(lines) or sum(len(s) for s in seen) >= len(lines)):
            return "generated", tokens
    return None, tokens


def inspect_files(files: DataFrame, key: str, group: str, path: str, content: str) -> DataFrame:
    """key, group, kind, prints (array of longs)."""
    schema = T.StructType([files.schema[key], files.schema[group], T.StructField("kind", T.StringType()), T.StructField("prints", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, prints = [], []
            for p, t in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist()):
                kind, tokens = inspect(p, t)
                kinds.append(kind)
                prints.append(fingerprints(tokens) if tokens else np.array([], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(group), pa.array(kinds, pa.string()), pa.array(prints, pa.list_(pa.int64()))], names=[key, group, "kind", "prints"])

    return spread(files.select(key, group, path, content).filter(F.col(content).isNotNull())).mapInArrow(run, schema)


def not_handwritten(files: DataFrame, key: str, group: str, path: str, content: str, owners: DataFrame | None = None) -> DataFrame:
    """``key`` and kind of the files that nobody wrote by hand for their repository.

    ``owners`` maps ``group`` to owner; without it each group is its own owner.
    """
    from quarry.scratch import Scratch

    seen = inspect_files(files, key, group, path, content)
    if owners is not None:
        seen = seen.join(owners.select(group, "owner"), group, "left").withColumn("owner", F.coalesce("owner", group))
    else:
        seen = seen.withColumn("owner", F.col(group))
    scratch = Scratch(files.sparkSession, "handwritten")
    seen = scratch.write(seen.select(key, "owner", "kind", "prints"))
    prints = seen.select("owner", F.explode("prints").alias("h"))
    recurring = prints.distinct().groupBy("h").count().filter(F.col("count") >= REPOSITORIES).select("h")
    each = seen.filter(F.size("prints") >= LEAST).select(key, F.size("prints").alias("n"), F.explode("prints").alias("h"))
    rows = seen.agg(F.sum(F.size("prints"))).first()[0] or 0
    shares = join_one(each, recurring, "h", hot_keys(each, "h", rows)).groupBy(key, "n").count()
    copies = scratch.write(shares.filter(F.col("count") >= SHARE * F.col("n")).select(key, F.lit("vendored").alias("kind")).distinct())
    shown = seen.filter("kind is not null").select(key, "kind").distinct()
    return copies.unionByName(shown.join(copies.select(key), key, "left_anti"))
