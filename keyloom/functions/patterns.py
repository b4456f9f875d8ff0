"""Glob patterns as column predicates, rewritten at plan time.

``*``, ``?``, ``[a-z]``, ``[!x]`` and ``\\`` are known. A pattern that is a plain text or a plain prefix
becomes an equality or ``startswith``, which Parquet scans can use to skip row groups.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

SPECIAL = set("*?[\\")


def glob_to_regex(pattern: str) -> str:
    """The regular expression (anchored, dot matches all) of a glob."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            found = _char_class(pattern, i)
            if found is None:  # never closed: matches nothing
                out.append("(?!)")
                break
            text, i = found
            out.append(text)
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def _char_class(pattern: str, start: int) -> tuple[str, int] | None:
    """The regex of the class that opens at ``start``, and where it closes."""
    i = start + 1
    negate = pattern[i : i + 1] == "!"
    i += negate
    parts, first = [], True
    esc = lambda c: "\\" + c if c in r"\^-]["  or c == "&" else c
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            body = "".join(parts)
            return ("[^" if negate else "[") + body + "]", i
        if c == "\\" and i + 1 < len(pattern):
            parts.append(esc(pattern[i + 1]))
            i += 2
        elif pattern[i + 1 : i + 2] == "-" and i + 2 < len(pattern) and pattern[i + 2] != "]":
            low, high = c, pattern[i + 2]
            if low <= high:
                parts.append(esc(low) + "-" + esc(high))
            i += 3
        else:
            parts.append(esc(c))
            i += 1
        first = False
    return None


def glob_match(value: Column, pattern: str) -> Column:
    if not SPECIAL & set(pattern):
        return value == pattern
    if pattern.endswith("*") and not SPECIAL & set(pattern[:-1]):
        return value.startswith(pattern[:-1])
    return value.rlike(glob_to_regex(pattern))
