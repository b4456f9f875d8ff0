"""The record log: an append-only Parquet table of versioned records.

Writes never read first: a batch is stamped, appended, and merged when it is read. Files are written
per bucket of the key's slot, so a reader of few keys opens few files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.scalars import SLOTS, SLOTS_PER_PARTITION, partition_id
from keyloom.operators.merge import lww

SCHEMA = (
    "key string, kind string, elem string, value string, hlc long, origin int, ttl_ms long, tomb boolean, "
    "observed array<struct<hlc:long,origin:int>>"
)


def stamp(rows: DataFrame, now_ms: int, origin: int, order: list[str], parts: int = 64) -> DataFrame:
    """Give a batch its versions: the batch's millisecond, then a running number within each key.

    The 16 low bits hold 65,536 writes a key and millisecond; further ones move to the next
    milliseconds, as the clock's send rule does.
    """
    nth = F.row_number().over(W.partitionBy("key").orderBy(*order)) - 1
    return rows.withColumns({"hlc": F.lit(now_ms << 16).cast("long") + nth, "origin": F.lit(origin)})


def append(rows: DataFrame, path: str, buckets: int = 64) -> None:
    bucketed = rows.withColumn("bucket", partition_id(F.col("key")) % buckets)
    bucketed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _crc16(data: bytes) -> int:
    """CRC-16 (polynomial 0x1021, initial 0) of a key's bytes, for keys that are known when a plan is made."""
    crc = 0
    for byte in data:
        x = (crc >> 8 ^ byte) & 0xFF
        x ^= x >> 4
        crc = (crc << 8 ^ x << 12 ^ x << 5 ^ x) & 0xFFFF
    return crc


def bucket_of_key(key: str, buckets: int = 64) -> int:
    tag = re.match(r"[^{]*\{([^}]+)\}", key)
    return _crc16((tag[1] if tag else key).encode()) % SLOTS // SLOTS_PER_PARTITION % buckets


def read_keys(spark: SparkSession, path: str, *keys: str, schema: str = SCHEMA, buckets: int = 64) -> DataFrame:
    """The records of some keys; only their buckets' folders are listed and read."""
    rows = spark.read.schema(schema + ", bucket int").parquet(path)
    return rows.where(F.col("bucket").isin(*{bucket_of_key(k, buckets) for k in keys}) & F.col("key").isin(*keys)).drop("bucket")


def compact(spark: SparkSession, path: str, to: str, buckets: int = 64) -> None:
    """Write the merged log to a new folder, sorted by key in each file, so row groups can be skipped.

    Only last-writer-wins records merge here; readers move to the new folder when it is complete.
    """
    state = lww(read(spark, path), ["key", "kind", "elem"], ["value"])
    bucketed = state.withColumn("bucket", partition_id(F.col("key")) % buckets)
    bucketed.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(to)


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """A JSON command log: one object a line with seq, cmd, key and args."""
    return spark.read.schema("seq long, cmd string, key string, args array<string>").json(path)


def commands_to_records(commands: DataFrame, now_ms: int, origin: int) -> DataFrame:
    """Records of the write commands SET, DEL, HSET, HDEL, SADD and SREM of a command log.

    A command without a record form is an error, so filter others out first. DEL is a tombstone of kind
    ``string``, from which ``heads_of`` makes the clock that buries the key's elements of every kind.
    """
    one = lambda kind, elem, value, tomb: F.array(F.struct(F.lit(kind).alias("kind"), elem.alias("elem"), value.alias("value"), F.lit(tomb).alias("tomb")))
    args, none = F.col("args"), F.lit(None).cast("string")
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size(args) / 2) - 1, F.lit(0)).cast("int")),
        lambda i: F.struct(F.lit("hash").alias("kind"), F.get(args, i * 2).alias("elem"), F.get(args, i * 2 + 1).alias("value"), F.lit(False).alias("tomb")),
    )
    every = lambda kind, tomb: F.transform(args, lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("elem"), none.alias("value"), F.lit(tomb).alias("tomb")))
    cmd = F.upper("cmd")
    records = (
        F.when(cmd == "SET", one("string", F.lit(""), F.get(args, F.lit(0)), False)).when(cmd == "DEL", one("string", F.lit(""), none, True))
        .when(cmd == "HSET", pairs).when(cmd == "HDEL", every("hash", True)).when(cmd == "SADD", every("set", False)).when(cmd == "SREM", every("set", True))
        .otherwise(F.raise_error(F.concat(F.lit("no records for command "), F.coalesce(cmd, F.lit("null")))))
    )
    rows = commands.select("key", "seq", F.posexplode(records).alias("nth", "r")).select("key", "seq", "nth", "r.*")
    return stamp(rows, now_ms, origin, ["seq", "nth"]).drop("seq", "nth").withColumn("ttl_ms", F.lit(0).cast("long"))


def heads_of(records: DataFrame) -> DataFrame:
    """The heads that DELs leave, for ``snapshot.visible``: all that a key held up to its last one is dead."""
    gone = records.where("kind = 'string' AND tomb").groupBy("key").agg(F.max("hlc").alias("hlc"))
    zero = F.lit(0).cast("long")
    return gone.select("key", "hlc", F.lit(0).alias("origin"), F.col("hlc").alias("del_hlc"), F.lit(False).alias("tomb"), zero.alias("ttl_ms"))
