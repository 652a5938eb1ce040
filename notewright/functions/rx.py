"""Patterns and small building blocks in Spark's regular-expression dialect.

(?d) makes line feeds the only line ends, (?U) makes classes Unicode-aware; groups
that repeat are possessive, so long inputs can't overflow the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[\\s\\x1C-\\x1F]"
LINE_END = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"(?U)\\A{WS}++|{WS}++\\z", "")


def split_lines(c: Column) -> Column:
    """Lines at all Unicode line ends; a last end opens no further line."""
    parts = F.split(c, LINE_END)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def symbols(text: str) -> str:
    """A pattern that is the text itself."""
    return "".join("\\" + x if not x.isalnum() else x for x in text)
