"""JSON documents (key, doc): reads by path, edits by path, decomposition into nodes.

Reads over static paths and all whole-document scalars stay built-in expressions; edits and dynamic
paths run in Arrow batches. Objects are rendered with members in byte order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from json.encoder import encode_basestring
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.jsonpath import dump, json_get, normal, parse, pretty, walk

__all__ = ["json_get", "get_many", "mget", "type_of", "edit", "apply_edits", "decompose", "merge_patch"]


def get_many(docs: DataFrame, paths: list[str], indent: str = "", newline: str = "", space: str = "") -> DataFrame:
    """JSON.GET with several paths: an object keyed by path, in byte order; a legacy path without a match is null."""
    parts = [F.concat(F.lit(json.dumps(p, ensure_ascii=False) + ":"), F.coalesce(json_get(F.col("doc"), p), F.lit("null"))) for p in sorted(set(paths), key=str.encode)]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return docs.select("key", pretty(F.when(F.try_parse_json("doc").isNotNull(), whole), indent, newline, space).alias("value"))


def mget(docs: DataFrame, requests: DataFrame, path: str) -> DataFrame:
    found = requests.join(docs.select("key", "doc"), "key", "left")
    return found.select("seq", "key", json_get(F.col("doc"), path).alias("value"))


TYPE_NAMES = {"VOID": "null", "BOOLEAN": "boolean", "BIGINT": "integer", "STRING": "string"}


def type_of(doc: Column, path: str = "$") -> Column:
    """The type of a static path's value: null, boolean, integer, number, string, array, object."""
    value = F.variant_get(F.parse_json(doc), normal(path)[0], "variant")
    name = F.schema_of_variant(value)
    known = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise(F.coalesce(F.try_element_at(known, name), F.when(name.isNotNull(), "number")))


def number_text(x: Column) -> Column:
    """A double as a JSON number: whole ones below 9e15 without a fraction, others in full below 1e16."""
    size = F.abs(x)
    plain = F.regexp_replace(x.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    powers = F.regexp_replace(F.lower(x.cast("string")), r"\.0e", "e")
    return F.when((F.floor(x) == x) & (size < 9e15), F.floor(x).cast("bigint").cast("string")).when((size >= 1e-5) & (size < 1e16), plain).otherwise(powers)


def numincrby(doc: Column, path: str, by: float, times: bool = False) -> Column:
    """JSON.NUMINCRBY and NUMMULTBY at a static path: the new number, an array of it for ``$`` paths.

    Whole numbers stay whole unless they overflow; what is no number, a string of digits included, answers null.
    """
    text, legacy = normal(path)
    value = F.variant_get(F.try_parse_json(doc), text, "variant")
    kind = F.schema_of_variant(value)
    real = F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("FLOAT", "DOUBLE"), F.try_variant_get(value, "$", "double"))
    loose = real * by if times else real + by
    new = F.when(~F.isnan(loose) & (F.abs(loose) < float("inf")), number_text(loose))
    if isinstance(by, int):
        whole, step = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")), F.lit(by).cast("bigint")
        new = F.coalesce((F.try_multiply(whole, step) if times else F.try_add(whole, step)).cast("string"), new)
    return new if legacy else F.when(F.try_parse_json(doc).isNotNull(), F.when(value.isNull(), "[]").otherwise(F.concat(F.lit("["), F.coalesce(new, F.lit("null")), F.lit("]"))))


def strlen(doc: Column, path: str = "$") -> Column:
    return F.octet_length(F.variant_get(F.parse_json(doc), normal(path)[0], "string")).cast("bigint")


def arrlen(doc: Column, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(doc, normal(path)[0])).cast("bigint")


def objkeys(doc: Column, path: str = "$") -> Column:
    return F.array_sort(F.json_object_keys(F.get_json_object(doc, normal(path)[0])))


def objlen(doc: Column, path: str = "$") -> Column:
    return F.size(F.json_object_keys(F.get_json_object(doc, normal(path)[0]))).cast("bigint")


# Edits: each takes the value at a location and returns (new value, reply).
Edit = Callable[[Any], tuple[Any, Any]]


def set_to(value: Any) -> Edit:
    return lambda old: (value, "OK")


def strappend(text: str) -> Edit:
    return lambda old: (old + text, len((old + text).encode())) if isinstance(old, str) else (old, None)


def toggle() -> Edit:
    return lambda old: (not old, int(not old)) if isinstance(old, bool) else (old, None)


def arrappend(*values: Any) -> Edit:
    return lambda old: (old + list(values), len(old) + len(values)) if isinstance(old, list) else (old, None)


def arrinsert(at: int, *values: Any) -> Edit:
    def do(old):
        if not isinstance(old, list):
            return old, None
        i = at + len(old) if at < 0 else at
        if not 0 <= i <= len(old):
            raise ValueError("index out of bounds")
        return old[:i] + list(values) + old[i:], len(old) + len(values)

    return do


def arrpop(at: int = -1) -> Edit:
    def do(old):
        if not isinstance(old, list):
            return old, None
        if not old:
            return old, None
        i = min(max(at + len(old) if at < 0 else at, 0), len(old) - 1)
        return old[:i] + old[i + 1 :], old[i]

    return do


def arrtrim(start: int, stop: int) -> Edit:
    def do(old):
        if not isinstance(old, list):
            return old, None
        n = len(old)
        low = max(start + n, 0) if start < 0 else start
        high = stop + n if stop < 0 else min(stop, n - 1)
        kept = old[low : high + 1] if low <= high else []
        return kept, len(kept)

    return do


def arrindex(value: Any, start: int = 0, stop: int = 0) -> Edit:
    """First index of ``value`` or -1; ``stop`` 0 means to the end."""

    def do(old):
        if not isinstance(old, list):
            return old, None
        n = len(old)
        low = max(n + start, 0) if start < 0 else min(start, n)
        high = min(n + stop if stop <= 0 else stop, n - 1)
        same = lambda x: x == value and isinstance(x, bool) == isinstance(value, bool)
        return old, next((i for i in range(low, high + 1) if i >= 0 and same(old[i])), -1)

    return do


def clear() -> Edit:
    def do(old):
        if isinstance(old, bool) or isinstance(old, str) or old is None:
            return old, 0
        if isinstance(old, (dict, list)):
            return type(old)(), int(bool(old))
        return 0, int(old != 0)

    return do


def delete() -> Edit:
    return lambda old: (_Gone, 1)


def merge(patch: Any) -> Edit:
    return lambda old: (merge_patch(old, patch), "OK")


class _Gone:
    """What an edit returns to remove its place; a class, so that it stays itself when sent to workers."""


def merge_patch(target: Any, patch: Any) -> Any:
    """RFC 7386: null deletes a member, objects merge, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def apply_edits(text: str | None, path: str, edit: Edit, create: bool = False) -> tuple[str | None, str | None]:
    """The document after an edit of every match, and the reply: an array of replies for ``$`` paths, the
    last match's for legacy ones. ``create`` adds a missing member to an object that is there."""
    if text is None:
        return None, None
    value, steps, legacy = json.loads(text), parse(path), normal(path)[1]
    places = [p for p, _ in walk(value, steps)]
    if not places and create and steps and steps[-1][1] == "names":
        for p, v in walk(value, steps[:-1]):
            if isinstance(v, dict):
                v[steps[-1][2][0]] = None
                places.append((*p, steps[-1][2][0]))
    replies = {}
    for place in sorted(places, key=lambda p: (len(p), tuple(map(str, p)), p and isinstance(p[-1], int) and p[-1] or 0), reverse=True):
        parent, at = value, None
        try:
            for at in place[:-1]:
                parent = parent[at]
            old = parent[place[-1]] if place else value
        except (KeyError, IndexError, TypeError):
            continue  # an edit of what holds it has removed it
        new, replies[place] = edit(old)
        if not place:
            value = None if new is _Gone else new
            if new is _Gone:
                return None, json.dumps([1] if not legacy else 1)
        elif new is _Gone:
            del parent[place[-1]]
        else:
            parent[place[-1]] = new
    listed = [replies.get(p) for p in places]
    reply = (listed[-1] if listed else None) if legacy else listed
    return dump(value), dump(reply)


def edit(docs: DataFrame, path: str, change: Edit, create: bool = False) -> DataFrame:
    """(key, doc, reply) of every document after ``change`` at ``path``."""
    parse(path)

    @F.pandas_udf("doc string, reply string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([apply_edits(t, path, change, create) for t in texts], columns=["doc", "reply"])

    return docs.select("key", run("doc").alias("__r")).select("key", "__r.doc", "__r.reply")


def _rebuilt(paths: list[str], kinds: list[str], values: list[str | None]) -> list[str]:
    """The text of every root among one key's nodes."""
    members: dict[str, list] = {}
    for i, path in enumerate(paths):
        if path.endswith("]"):
            up, _, at = path[:-1].rpartition("[")
            members.setdefault(up, []).append((1, int(at), i))
        elif "." in path or "[" in path:
            up, _, name = path.rpartition(".")
            members.setdefault(up, []).append((0, name, i))

    def text(i: int) -> str:
        inner = [f"{encode_basestring(step)}:{text(k)}" if named == 0 else text(k) for named, step, k in sorted(members.get(paths[i], ()))]
        if kinds[i] == "array":
            return f"[{','.join(inner)}]"
        return f"{{{','.join(inner)}}}" if inner or kinds[i] == "object" else "null" if values[i] is None else values[i]

    return [text(i) for i, path in enumerate(paths) if "." not in path and "[" not in path]


def build(nodes: DataFrame, key: str = "key") -> DataFrame:
    """(key, doc): documents from their nodes (path, kind, value) as ``decompose`` gives them, in any order.

    One shuffle brings a document's nodes together; a task holds one batch of documents and no whole table.
    Members' names without dots and brackets are assumed, as paths are text.
    """

    @F.arrow_udf("array<string>")
    def run(found: pa.Array) -> pa.Array:
        flat, ends = found.flatten(), found.offsets.to_pylist()
        columns = [flat.field(i).to_pylist() for i in range(3)]
        return pa.array([_rebuilt(*(c[i - ends[0] : j - ends[0]] for c in columns)) for i, j in zip(ends, ends[1:], strict=False)], pa.list_(pa.string()))

    return nodes.groupBy(key).agg(F.collect_list(F.struct("path", "kind", "value")).alias("__n")).select(key, F.explode(run("__n")).alias("doc"))


def resp(value: Any) -> Any:
    """JSON.RESP: arrays led by ``[``, objects by ``{`` and flattened; booleans and fractions as text."""
    if isinstance(value, dict):
        return ["{", *[x for k in sorted(value, key=lambda s: s.encode()) for x in (k, resp(value[k]))]]
    if isinstance(value, list):
        return ["[", *map(resp, value)]
    if isinstance(value, bool):
        return "true" if value else "false"
    return dump(value) if isinstance(value, float) else value


def _add_nodes(path: str, v: Any, paths: list, kinds: list, values: list) -> None:
    paths.append(path)
    if isinstance(v, dict):
        kinds.append("object")
        values.append(None)
        for k in sorted(v):  # by code point, which is byte order
            _add_nodes(f"{path}.{k}", v[k], paths, kinds, values)
    elif isinstance(v, list):
        kinds.append("array")
        values.append(None)
        for i, x in enumerate(v):
            _add_nodes(f"{path}[{i}]", x, paths, kinds, values)
    else:
        kind = "null" if v is None else LEAVES[type(v)]
        kinds.append(kind)
        values.append(encode_basestring(v) if kind == "string" else str(v) if kind == "integer" else dump(v))


LEAVES = {bool: "boolean", int: "integer", float: "number", str: "string"}


def decompose(doc: Column | str) -> Column:
    """A document as one struct (path, kind, value) for each node: its path, its kind, and a leaf's value."""

    @F.arrow_udf("array<struct<path:string,kind:string,value:string>>")
    def run(texts: pa.Array) -> pa.Array:
        columns, starts = ([], [], []), []
        for t in texts.to_pylist():
            starts.append(None if t is None else len(columns[0]))
            if t is not None:
                _add_nodes("$", json.loads(t), *columns)
        found = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "kind", "value"])
        return pa.ListArray.from_arrays(pa.array([*starts, len(columns[0])], pa.int32()), found)

    return run(doc)


def mset(docs: DataFrame, writes: DataFrame) -> DataFrame:
    """JSON.MSET over whole documents: writes (key, doc, seq), the last of each key wins."""
    new = writes.groupBy("key").agg(F.max_by("doc", "seq").alias("doc"))
    return docs.select("key", "doc").join(new.select("key"), "key", "left_anti").unionByName(new)


def debug_memory(docs: DataFrame, path: str = "$") -> DataFrame:
    """JSON.DEBUG MEMORY: (key, bytes) of the paths and leaves stored at or below ``path``."""
    prefix = normal(path)[0]
    rows = docs.select("key", F.inline(decompose("doc")))
    below = (F.col("path") == prefix) | F.col("path").startswith(prefix + ".") | F.col("path").startswith(prefix + "[")
    size = F.octet_length("path") + F.coalesce(F.octet_length("value"), F.lit(0))
    return rows.where(below).groupBy("key").agg(F.sum(size).cast("bigint").alias("bytes"))


def resp_text(doc: Column | str) -> Column:
    """JSON.RESP of whole documents, as JSON text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else dump(resp(json.loads(t))), na_action=None)

    return run(doc)
