"""String expressions that several operators share. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ``strip`` removes from padded identifiers.
BLANKS = " \t\n\r\f\x0b "


def strip(c: Column) -> Column:
    """Remove white space (blanks, tabs, line ends, no-break spaces) at both ends; null stays null."""
    return F.trim(c, F.lit(BLANKS))


def clean_path(c: Column) -> Column:
    """One spelling per path: backslashes become slashes and leading ``./`` go. Null stays null."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(?:\./)+", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
