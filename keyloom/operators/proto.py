"""Protobuf values: a registry of descriptors, bindings by prefix, and reads and edits of fields.

Messages are binary columns; descriptors are small and travel with the functions that need them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Registry:
    """PROTO.SCHEMA, BIND, UNBIND and BINDINGS: versions of descriptor files, and types bound to prefixes."""

    versions: dict[str, dict[int, bytes]] = field(default_factory=dict)
    bindings: dict[str, tuple[str, str, int]] = field(default_factory=dict)
    latest: dict[str, int] = field(default_factory=dict)

    def set_schema(self, name: str, descriptors: bytes) -> int:
        """Store a serialized FileDescriptorSet; versions count up and stay readable after a delete."""
        _pool(descriptors)
        version = max(self.versions.get(name, {0: b""})) + 1
        self.versions.setdefault(name, {})[version] = descriptors
        self.latest[name] = version
        return version

    def delete_schema(self, name: str) -> bool:
        return self.latest.pop(name, None) is not None

    def get_schema(self, name: str, version: int = 0) -> bytes:
        return self.versions[name][version or self.latest[name]]

    def types(self, name: str) -> list[str]:
        files = descriptor_pb2.FileDescriptorSet.FromString(self.get_schema(name))
        return sorted(f"{f.package}.{m.name}".lstrip(".") for f in files.file for m in f.message_type)

    def bind(self, prefix: str, type_name: str, schema: str | None = None, version: int = 0) -> None:
        """Bind a type to keys of a prefix; version 0 follows the latest."""
        holders = [s for s in self.latest if type_name in self.types(s)] if schema is None else [schema]
        if len(holders) != 1 or type_name not in self.types(holders[0]):
            raise ValueError(f"type is {'ambiguous' if len(holders) > 1 else 'unknown'}: {type_name}")
        self.bindings[prefix] = (type_name, holders[0], version)

    def unbind(self, prefix: str) -> bool:
        return self.bindings.pop(prefix, None) is not None

    def bound(self, key: str) -> tuple[str, bytes]:
        prefix = max((p for p in self.bindings if key.startswith(p)), key=len)
        type_name, schema, version = self.bindings[prefix]
        return type_name, self.get_schema(schema, version)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, t, s, v) for p, (t, s, v) in sorted(self.bindings.items())]
        return spark.createDataFrame(rows, "prefix string, type string, schema string, version int")


def _pool(descriptors: bytes) -> descriptor_pool.DescriptorPool:
    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        pool.Add(f)
    return pool


def message_class(descriptors: bytes, type_name: str):
    return message_factory.GetMessageClass(_pool(descriptors).FindMessageTypeByName(type_name))


def _mapped(kind: str, descriptors: bytes, type_name: str, work: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        cls = message_class(descriptors, type_name)
        return values.map(lambda v: None if v is None else work(cls, v), na_action=None)

    return run


def set_json(value: Column, descriptors: bytes, type_name: str) -> Column:
    """PROTO.SETJSON: the message that a JSON text describes; null where it does not fit the type."""

    def work(cls, text):
        try:
            return json_format.Parse(text, cls()).SerializeToString(deterministic=True)
        except json_format.ParseError:
            return None

    return _mapped("binary", descriptors, type_name, work)(value)


def get_json(value: Column, descriptors: bytes, type_name: str) -> Column:
    """PROTO.GETJSON and HGETJSON: canonical JSON, members sorted."""
    return _mapped("string", descriptors, type_name, lambda cls, v: json.dumps(json_format.MessageToDict(cls.FromString(v)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))(value)


def validate(value: Column, descriptors: bytes, type_name: str) -> Column:
    """Whether bytes decode as the type: the gate of PROTO.SET, HSET and SADD."""

    def work(cls, v):
        try:
            cls.FromString(v)
            return True
        except Exception:  # the library raises its own errors for bytes of other kinds
            return False

    return _mapped("boolean", descriptors, type_name, work)(value)


def hset(hashes: DataFrame, writes: DataFrame, descriptors: bytes, type_name: str) -> tuple[DataFrame, DataFrame]:
    """PROTO.HSET: hashes (key, field, value) after the writes (key, field, value, seq) that decode as the type, the
    last of each field; and the writes that are refused."""
    held, refused = _gated(writes, descriptors, type_name)
    new = held.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    return hashes.select("key", "field", "value").join(new.select("key", "field"), ["key", "field"], "left_anti").unionByName(new), refused


def sadd(sets: DataFrame, writes: DataFrame, descriptors: bytes, type_name: str) -> tuple[DataFrame, DataFrame]:
    """PROTO.SADD: sets (key, member) with the members that decode as the type, and the writes that are refused."""
    held, refused = _gated(writes.withColumnRenamed("member", "value"), descriptors, type_name)
    new = held.select("key", F.col("value").alias("member"))
    return sets.select("key", "member").unionByName(new).distinct(), refused.withColumnRenamed("value", "member")


def _gated(writes: DataFrame, descriptors: bytes, type_name: str) -> tuple[DataFrame, DataFrame]:
    step = writes.withColumn("__ok", F.coalesce(validate(F.col("value"), descriptors, type_name), F.lit(False)))
    return step.where("__ok").drop("__ok"), step.where("NOT __ok").drop("__ok")


def get(messages: DataFrame) -> DataFrame:
    """PROTO.GET: the messages' bytes as they are stored."""
    return messages.select("key", "value")


def _field(message, name: str):
    d = message.DESCRIPTOR
    return d.fields_by_number.get(int(name)) if name.isdigit() else d.fields_by_name.get(name)


def _is_map(f) -> bool:
    return f.message_type is not None and f.message_type.GetOptions().map_entry


def _text(value, f) -> str | None:
    if f.enum_type is not None:
        known = f.enum_type.values_by_number.get(value)
        return known.name if known else str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if f.message_type is not None and hasattr(value, "DESCRIPTOR"):
        return json.dumps(json_format.MessageToDict(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return str(value)


def read_path(message, path: str) -> str | None:
    """A field as text: names or numbers, list indexes, map keys; null where unset or out of range."""
    value, f, parts = message, None, path.split(".")
    while parts:
        part = parts.pop(0)
        if not hasattr(value, "DESCRIPTOR"):
            raise ValueError(f"not a message: {path}")
        f = _field(value, part)
        if f is None:
            raise ValueError(f"unknown field: {part}")
        if _is_map(f):
            held = getattr(value, f.name)
            entry = f.message_type.fields_by_name
            if not parts:
                return json.dumps(json_format.MessageToDict(value).get(f.json_name, {}), sort_keys=True, separators=(",", ":"))
            want = next((k for k in held if str(k) == parts[0]), None)
            if want is None:
                return None
            parts.pop(0)
            value, f = held[want], entry["value"]
        elif f.is_repeated if hasattr(f, "is_repeated") else f.label == f.LABEL_REPEATED:
            held = getattr(value, f.name)
            if not parts:
                return json.dumps(json_format.MessageToDict(value).get(f.json_name, []), sort_keys=True, separators=(",", ":"))
            at = int(parts.pop(0))
            if not 0 <= at < len(held):
                return None
            value = held[at]
        else:
            if f.has_presence and not value.HasField(f.name):
                return None
            value = getattr(value, f.name)
            if not f.has_presence and not value:
                return None
    return _text(value, f)


def get_field(value: Column, descriptors: bytes, type_name: str, path: str) -> Column:
    """PROTO.GETFIELD and HGETFIELD."""
    return _mapped("string", descriptors, type_name, lambda cls, v: read_path(cls.FromString(v), path))(value)


def set_fields(value: Column, descriptors: bytes, type_name: str, changes: dict[str, object]) -> Column:
    """PROTO.SETFIELD: the message with top-level or nested single fields set, given as JSON values."""

    def work(cls, v):
        message = cls.FromString(v)
        for path, new in changes.items():
            tree: object = new
            for part in reversed(path.split(".")):
                tree = {part: tree}
            json_format.ParseDict(tree, message)
        return message.SerializeToString(deterministic=True)

    return _mapped("binary", descriptors, type_name, work)(value)


def clear_fields(value: Column, descriptors: bytes, type_name: str, paths: list[str]) -> Column:
    """PROTO.CLEARFIELD: the message without some fields."""

    def work(cls, v):
        message = cls.FromString(v)
        for path in paths:
            *parents, last = path.split(".")
            at = message
            for p in parents:
                at = getattr(at, _field(at, p).name)
            at.ClearField(_field(at, last).name)
        return message.SerializeToString(deterministic=True)

    return _mapped("binary", descriptors, type_name, work)(value)


def info(messages: DataFrame, type_name: str, schema: str, version: int) -> DataFrame:
    """PROTO.INFO: (key, schema, version, type, bytes)."""
    return messages.select("key", F.lit(schema).alias("schema"), F.lit(version).alias("version"), F.lit(type_name).alias("type"), F.octet_length("value").alias("bytes"))


def decompose(value: Column, descriptors: bytes, type_name: str) -> Column:
    """A message as its set fields: array of (number, json)."""

    def work(cls, v):
        message = cls.FromString(v)
        whole = json_format.MessageToDict(message)
        return [{"number": f.number, "value": json.dumps(whole.get(f.json_name), sort_keys=True, separators=(",", ":"))} for f, _ in message.ListFields()]

    return _mapped("array<struct<number:int,value:string>>", descriptors, type_name, work)(value)



def recompose(fields: DataFrame, descriptors: bytes, type_name: str) -> DataFrame:
    """(key, value): messages from their fields (key, number, value) as ``decompose`` gives them; one message is one group."""
    names = {f.number: f.json_name for f in message_class(descriptors, type_name).DESCRIPTOR.fields}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    member = F.concat(F.lit('"'), F.try_element_at(known, F.col("number")), F.lit('":'), F.col("value"))
    text = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(member)), ","), F.lit("}"))
    return fields.groupBy("key").agg(text.alias("__t")).select("key", set_json(F.col("__t"), descriptors, type_name).alias("value"))
