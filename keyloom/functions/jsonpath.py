"""JSON paths over JSON texts.

Paths that only name members and non-negative indexes compile to variant expressions, which stay in the
JVM. The others (wildcards, descent, slices, negative indexes, filters) run in an Arrow-batched function.
A path that starts with ``$`` answers an array of matches; a legacy path answers its first match or null.
Answers are JSON texts: strings are quoted, JSON null is ``null``, whole floats have no fraction. Static
paths render a number written with an exponent as a double.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STATIC = re.compile(r"^\$(\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*$")
NAME = re.compile(r"[A-Za-z_\u0080-￿][\w\u0080-￿-]*")
TEST = re.compile(r"""^\s*@((?:\.[\w-]+|\[\d+\])*)\s*(?:(==|!=|<=|>=|<|>)\s*(.+?))?\s*$""")


COMPACT = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def normal(path: str) -> tuple[str, bool]:
    """The path as ``$...``, and whether it was written in the legacy way."""
    if path.startswith("$"):
        return path, False
    if path in ("", "."):
        return "$", True
    return "$" + (path if path[0] in ".[" else "." + path), True


def is_static(path: str) -> bool:
    return bool(STATIC.match(normal(path)[0]))


def parse(path: str) -> list[tuple]:
    text, steps, i = normal(path)[0], [], 1
    while i < len(text):
        deep = text.startswith("..", i)
        if deep:
            i += 2
        elif text[i] == ".":
            i += 1
        if text[i : i + 1] == "[":
            end = _close(text, i)
            steps.append((deep, *_bracket(text[i + 1 : end].strip())))
            i = end + 1
        elif text[i : i + 1] == "*":
            steps.append((deep, "all", None))
            i += 1
        else:
            m = NAME.match(text, i)
            if not m:
                raise ValueError(f"bad path at {i}: {path!r}")
            steps.append((deep, "names", [m[0]]))
            i = m.end()
    return steps


def _close(text: str, i: int) -> int:
    depth, quote = 0, ""
    for k in range(i, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote and text[k - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return k
    raise ValueError(f"unclosed bracket: {text!r}")


def _bracket(body: str) -> tuple:
    if body == "*":
        return ("all", None)
    if body.startswith("?"):
        inner = body[1:].strip()
        inner = inner[1:-1] if inner.startswith("(") and inner.endswith(")") else inner
        return ("filter", [[_test(t) for t in part.split("&&")] for part in inner.split("||")])
    if ":" in body and body[0] not in "'\"":
        return ("slice", slice(*[int(x) if x.strip() else None for x in body.split(":")]))
    keys = [k.strip() for k in re.findall(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,]+", body)]
    if all(k[0] in "'\"" for k in keys):
        return ("names", [re.sub(r"\\(.)", r"\1", k[1:-1]) for k in keys])
    return ("indexes", [int(k) for k in keys])


def _test(text: str) -> tuple:
    m = TEST.match(text)
    if not m:
        raise ValueError(f"bad filter: {text!r}")
    value = json.loads(m[3].replace("'", '"')) if m[3] else None
    return parse("$" + m[1]), m[2], value


def _same_kind(a: Any, b: Any) -> bool:
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return number(a) and number(b) or isinstance(a, str) and isinstance(b, str)


def _holds(value: Any, tests: list) -> bool:
    def one(steps, op, want) -> bool:
        found = [v for _, v in walk(value, steps)]
        if op is None:
            return bool(found)
        if not found:
            return op == "!="
        got = found[0]
        if op in ("==", "!="):
            equal = got == want and isinstance(got, bool) == isinstance(want, bool)
            return equal == (op == "==")
        if not _same_kind(got, want):
            return False
        return {"<": got < want, "<=": got <= want, ">": got > want, ">=": got >= want}[op]

    return any(all(one(*t) for t in every) for every in tests)


def _children(value: Any):
    if isinstance(value, dict):
        for k in sorted(value):  # by code point, which is byte order
            yield k, value[k]
    elif isinstance(value, list):
        yield from enumerate(value)


def _descend(path: tuple, value: Any):
    yield path, value
    for k, v in _children(value):
        yield from _descend((*path, k), v)


def _pick(path: tuple, value: Any, kind: str, what: Any):
    if kind == "names" and isinstance(value, dict):
        yield from (((*path, n), value[n]) for n in what if n in value)
    elif kind == "indexes" and isinstance(value, list):
        for i in what:
            if -len(value) <= i < len(value):
                yield (*path, i % len(value)), value[i]
    elif kind == "all":
        yield from (((*path, k), v) for k, v in _children(value))
    elif kind == "slice" and isinstance(value, list):
        yield from (((*path, i), value[i]) for i in range(*what.indices(len(value))))
    elif kind == "filter":
        yield from (((*path, k), v) for k, v in _children(value) if _holds(v, what))


def walk(value: Any, steps: list[tuple]):
    """(location, value) of each match, in document order."""
    found = [((), value)]
    for deep, kind, what in steps:
        if deep:
            found = [x for p, v in found for x in _descend(p, v)]
        found = [x for p, v in found for x in _pick(p, v, kind, what)]
    return found


def dump(value: Any) -> str:
    """Canonical JSON: members in byte order, no spaces, whole floats below 9e15 without a fraction."""
    text = COMPACT.encode(value)
    return COMPACT.encode(_whole(value)) if ".0" in text else text


def _whole(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_whole(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 9e15 else value


def json_get(doc: Column, path: str, indent: str = "", newline: str = "", space: str = "") -> Column:
    """JSON.GET with one path; a text that is no JSON has no values."""
    return pretty(_compact(doc, path), indent, newline, space)


def _compact(doc: Column, path: str) -> Column:
    text, legacy = normal(path)
    if is_static(path):
        whole = F.try_parse_json(doc)
        found = F.to_json(F.variant_get(whole, text, "variant"))
        return found if legacy else F.when(whole.isNotNull(), F.concat(F.lit("["), F.coalesce(found, F.lit("")), F.lit("]")))
    steps = parse(path)

    @F.pandas_udf("string")
    def found(docs: pd.Series) -> pd.Series:
        def one(d):
            try:
                value = json.loads(d) if d is not None else None
            except ValueError:
                return None
            if d is None:
                return None
            values = [v for _, v in walk(value, steps)]
            return (dump(values[0]) if values else None) if legacy else dump(values)

        return docs.map(one, na_action=None)

    return found(doc)


def laid_out(value: Any, indent: str, newline: str, space: str, depth: int = 0) -> str:
    """A value with ``indent`` once a level, ``newline`` around members and ``space`` after colons; empty containers stay closed."""
    if isinstance(value, dict):
        inner = [f"{json.dumps(k, ensure_ascii=False)}:{space}{laid_out(value[k], indent, newline, space, depth + 1)}" for k in sorted(value, key=lambda s: s.encode())]
    elif isinstance(value, list):
        inner = [laid_out(v, indent, newline, space, depth + 1) for v in value]
    else:
        return dump(value)
    left, right = "{}" if isinstance(value, dict) else "[]"
    if not inner:
        return left + right
    step = newline + indent * (depth + 1)
    return left + step + ("," + step).join(inner) + newline + indent * depth + right


def pretty(text: Column, indent: str = "", newline: str = "", space: str = "") -> Column:
    """JSON texts laid out as INDENT, NEWLINE and SPACE ask."""
    if not (indent or newline or space):
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else laid_out(json.loads(t), indent, newline, space), na_action=None)

    return run(text)
