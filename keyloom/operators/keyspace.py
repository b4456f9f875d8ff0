"""Operators over whole keys: existence, types, deadlines, renames, scans.

``catalog`` is (key, type, ttl_ms): one row for each visible key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.patterns import glob_match
from keyloom.functions.scalars import hash_tag, keyslot, partition_id


def delete(records: DataFrame, keys: DataFrame, hlc: Column, origin: int = 0) -> DataFrame:
    """Tombstones for the keys that exist; elements die by the delete clock they carry."""
    there = records.select("key").distinct().join(keys.select("key").distinct(), "key", "left_semi")
    return there.select("key", hlc.alias("hlc"), F.lit(origin).alias("origin"), hlc.alias("del_hlc"), F.lit(True).alias("tomb"), F.lit(0).cast("bigint").alias("ttl_ms"))


def exists(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """(n): how many requests name a key that exists; a key named twice counts twice. TOUCH alike."""
    return requests.join(catalog.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


def type_of(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    found = requests.join(catalog.select("key", "type"), "key", "left")
    return found.select("seq", "key", F.coalesce("type", F.lit("none")).alias("type"))


def ttl(catalog: DataFrame, requests: DataFrame, now_ms: int, unit_ms: int = 1000, absolute: bool = False) -> DataFrame:
    """TTL, PTTL, EXPIRETIME, PEXPIRETIME: -2 without the key, -1 without a deadline."""
    found = requests.join(catalog.select("key", "ttl_ms"), "key", "left")
    left = F.floor((F.col("ttl_ms") - (0 if absolute else now_ms)) / unit_ms)
    return found.select("seq", "key", F.when(F.col("ttl_ms").isNull(), -2).when(F.col("ttl_ms") == 0, -1).otherwise(left).cast("bigint").alias("reply"))


def expire(catalog: DataFrame, requests: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The catalog after requests (key, deadline), and (key, reply); a past deadline deletes at once."""
    step = catalog.join(requests, "key", "left")
    replies = requests.join(catalog.select("key").withColumn("__t", F.lit(1)), "key", "left").select("key", F.coalesce("__t", F.lit(0)).cast("bigint").alias("reply"))
    after = step.where(F.col("deadline").isNull() | (F.col("deadline") > now_ms)).withColumn("ttl_ms", F.coalesce("deadline", "ttl_ms"))
    return after.select(*catalog.columns), replies


def persist(catalog: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    step = catalog.join(keys.select("key").distinct().withColumn("__p", F.lit(True)), "key", "left")
    after = step.withColumn("ttl_ms", F.when(F.col("__p"), F.lit(0)).otherwise(F.col("ttl_ms")).cast("bigint")).select(*catalog.columns)
    reply = keys.select("key").join(catalog.select("key", "ttl_ms"), "key", "left").select("key", F.when(F.coalesce(F.col("ttl_ms"), F.lit(0)) != 0, 1).otherwise(0).cast("bigint").alias("reply"))
    return after, reply


def expire_members(elements: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """EXPIREMEMBER: elements (key, elem, ttl_ms, ...) given deadlines; their dots stay, past ones go."""
    step = elements.join(requests.select("key", "elem", "deadline"), ["key", "elem"], "left").where(F.col("deadline").isNull() | (F.col("deadline") > now_ms))
    return step.withColumn("ttl_ms", F.coalesce("deadline", "ttl_ms")).select(*elements.columns)


def keys(catalog: DataFrame, pattern: str) -> DataFrame:
    return catalog.where(glob_match(F.col("key"), pattern)).select("key")


def scan(catalog: DataFrame, cursor: str, count: int, pattern: str | None = None) -> DataFrame:
    """The next ``count`` keys after ``cursor`` in key order: a page by position in the order, not by offset."""
    rows = catalog.select("key").where(F.col("key") > cursor)
    if pattern is not None:
        rows = rows.where(glob_match(F.col("key"), pattern))
    return rows.orderBy("key").limit(count)


def randomkey(catalog: DataFrame) -> DataFrame:
    """The first key in store order: partition, then key."""
    return catalog.select("key", partition_id(F.col("key")).alias("pid")).orderBy("pid", "key").limit(1).select("key")


def rename(records: DataFrame, pairs: DataFrame, only_new: bool = False) -> DataFrame:
    """Records after renames (src, dst): the source's rows under the new key, the target's old rows gone."""
    return _copied(records, pairs, keep_source=False, replace=not only_new)


def copy(records: DataFrame, pairs: DataFrame, replace: bool = False) -> DataFrame:
    return _copied(records, pairs, keep_source=True, replace=replace)


def _copied(records: DataFrame, pairs: DataFrame, keep_source: bool, replace: bool) -> DataFrame:
    there = records.select("key").distinct()
    done = pairs.join(there.withColumnRenamed("key", "src"), "src", "left_semi")
    if not replace:
        done = done.join(there.withColumnRenamed("key", "dst"), "dst", "left_anti")
    moved = records.join(done.withColumnRenamed("src", "key"), "key").withColumn("key", F.col("dst")).select(*records.columns)
    gone = done.select(F.col("dst").alias("key"))
    if not keep_source:
        gone = gone.unionByName(done.select(F.col("src").alias("key")))
    return records.join(gone.distinct(), "key", "left_anti").select(*records.columns).unionByName(moved)


def slots(keyed: DataFrame) -> DataFrame:
    """(key, tag, slot, pid)."""
    return keyed.select("key", hash_tag(F.col("key")).alias("tag"), keyslot(F.col("key")).alias("slot"), partition_id(F.col("key")).alias("pid"))


ENCODINGS = {"string": "raw", "list": "quicklist", "hash": "hashtable", "set": "hashtable", "zset": "skiplist", "stream": "stream"}


def object_encoding(catalog: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair])
    return catalog.select("key", F.coalesce(F.try_element_at(table, F.col("type")), F.lit("raw")).alias("encoding"))


def dbsize(catalog: DataFrame) -> DataFrame:
    return catalog.select("key").distinct().agg(F.count("*").alias("n"))


def flushall(catalog: DataFrame, hlc: Column) -> DataFrame:
    """A tombstone for every key."""
    return delete(catalog, catalog, hlc)


def info(catalog: DataFrame) -> DataFrame:
    """(type, keys, expiring): the keyspace section of INFO."""
    return catalog.groupBy("type").agg(F.count("*").alias("keys"), F.count_if(F.col("ttl_ms") != 0).alias("expiring"))
