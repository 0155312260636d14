"""Comparing JSON texts by value."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(text: str) -> str:
    """The same text for every spelling of one number; exact, without floating point."""
    try:
        d = Decimal(text)
    except InvalidOperation:
        return text
    if not d:
        return "0"
    sign, digits, exponent = d.as_tuple()
    s = "".join(map(str, digits))
    kept = s.rstrip("0")
    return f"{'-' * sign}{kept}e{exponent + len(s) - len(kept)}"


class _N(str):
    __slots__ = ()


def _dump(v, out: list[str]) -> None:
    if isinstance(v, _N):
        out.append(v)
    elif isinstance(v, dict):
        out.append("{")
        for k in sorted(v):
            out.append(json.dumps(k))
            out.append(":")
            _dump(v[k], out)
            out.append(",")
        out.append("}")
    elif isinstance(v, list):
        out.append("[")
        for x in v:
            _dump(x, out)
            out.append(",")
        out.append("]")
    else:
        out.append(json.dumps(v))


_DECODER = json.JSONDecoder(parse_int=lambda t: _N(_number(t)), parse_float=lambda t: _N(_number(t)), parse_constant=_N)


def canonical(text: str | None) -> str:
    """A text that two JSON documents share exactly when their values are equal. Null and blank equal ``{}``;
    of a repeated member the last counts; a text that is no JSON stands for itself."""
    if text is None or not text.strip():
        return "{}"
    try:
        value = _DECODER.decode(text.strip())
        out: list[str] = []
        _dump(value, out)
        return "".join(out)
    except (ValueError, RecursionError):
        return "!" + text


@F.pandas_udf(T.BinaryType())
def json_value_hash(texts: pd.Series) -> pd.Series:
    """128 bits of SHA-256 over the canonical value; equal for equal values."""
    seen: dict = {}

    def one(t):
        h = seen.get(t)
        if h is None:
            h = seen[t] = hashlib.sha256(canonical(t).encode("utf-8", "surrogatepass")).digest()[:16]
        return h

    return pd.Series([one(t if isinstance(t, str) else None) for t in texts])
