"""Hashes (key, field, value[, ttl_ms])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.patterns import glob_match


def hset(hashes: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hashes after writes (key, field, value, seq), and (key, created): fields that are new."""
    new = writes.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    fresh = new.join(hashes.select("key", "field"), ["key", "field"], "left_anti")
    after = hashes.select("key", "field", "value").join(new.select("key", "field"), ["key", "field"], "left_anti").unionByName(new)
    made = new.select("key").distinct().join(fresh.groupBy("key").agg(F.count("*").alias("created")), "key", "left")
    return after, made.select("key", F.coalesce("created", F.lit(0)).alias("created"))


def hsetnx(hashes: DataFrame, writes: DataFrame) -> DataFrame:
    """The writes whose field is absent; of several to one field, the first."""
    first = writes.groupBy("key", "field").agg(F.min_by("value", "seq").alias("value"))
    return first.join(hashes.select("key", "field"), ["key", "field"], "left_anti")


def hsetex(hashes: DataFrame, requests: DataFrame, condition: str) -> DataFrame:
    """FNX or FXX: requests (req, key, field, value) all of whose fields are absent, or present."""
    there = requests.join(hashes.select("key", "field").withColumn("__t", F.lit(True)), ["key", "field"], "left")
    ok = F.every(F.col("__t").isNull() if condition == "FNX" else F.col("__t").isNotNull()).over(W.partitionBy("req"))
    return there.withColumn("__ok", ok).where("__ok").select("req", "key", "field", "value")


def hget(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    """(seq, key, field, value); null where there is none."""
    return requests.join(hashes.select("key", "field", "value"), ["key", "field"], "left").select("seq", "key", "field", "value")


def hmget(hashes: DataFrame, fields: list[str]) -> DataFrame:
    """(key, values): one value or null for each field, in the order asked, of every key."""
    picks = [F.max(F.when(F.col("field") == f, F.col("value"))) for f in fields]
    return hashes.groupBy("key").agg(F.array(*picks).alias("values"))


def hgetall(hashes: DataFrame) -> DataFrame:
    """(key, entries): (field, value) pairs in byte order of the field."""
    return hashes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("entries"))


def hkeys(hashes: DataFrame) -> DataFrame:
    return hgetall(hashes).select("key", F.transform("entries", lambda e: e["field"]).alias("fields"))


def hvals(hashes: DataFrame) -> DataFrame:
    return hgetall(hashes).select("key", F.transform("entries", lambda e: e["value"]).alias("values"))


def hlen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count("*").alias("length"))


def hexists(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    there = hashes.select("key", "field").withColumn("__t", F.lit(1))
    return requests.join(there, ["key", "field"], "left").select("seq", "key", "field", F.coalesce("__t", F.lit(0)).cast("bigint").alias("reply"))


def hstrlen(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    return hget(hashes, requests).select("seq", "key", "field", F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)).cast("bigint").alias("length"))


def hdel(hashes: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What remains, and (key, removed)."""
    gone = hashes.join(removals.select("key", "field").distinct(), ["key", "field"], "left_semi")
    return hashes.join(removals.select("key", "field"), ["key", "field"], "left_anti"), gone.groupBy("key").agg(F.count("*").alias("removed"))


def hgetdel(hashes: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, field, value) of what is read and removed, and what remains."""
    pairs = removals.select("key", "field").distinct()
    return hashes.join(pairs, ["key", "field"], "left_semi"), hashes.join(pairs, ["key", "field"], "left_anti")


def hincrby(hashes: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, field, value, error): 64-bit sums of deltas (key, field, delta)."""
    sums = deltas.groupBy("key", "field").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("__d"))
    step = sums.join(hashes.select("key", "field", F.col("value").alias("__v")), ["key", "field"], "left")
    old = F.when(F.col("__v").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("__v").try_cast("bigint"))
    value = (old.cast("decimal(38,0)") + F.col("__d")).try_cast("bigint")
    return step.select("key", "field", value.alias("value"), value.isNull().alias("error"))


def hincrbyfloat(hashes: DataFrame, deltas: DataFrame) -> DataFrame:
    sums = deltas.groupBy("key", "field").agg(F.sum(F.col("delta").cast("double")).alias("__d"))
    step = sums.join(hashes.select("key", "field", F.col("value").alias("__v")), ["key", "field"], "left")
    total = F.coalesce(F.col("__v").try_cast("double"), F.lit(0.0)) + F.col("__d")
    return step.select("key", "field", F.when(~F.isnan(total) & (F.abs(total) < float("inf")), total).alias("value"))


def hrandfield(hashes: DataFrame, count: int, seed: int) -> DataFrame:
    """(key, field, value) of ``count`` fields of each key, by a seeded order."""
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "field")), "field"))
    return hashes.withColumn("__n", nth).where(F.col("__n") <= abs(count)).select("key", "field", "value")


def hscan(hashes: DataFrame, pattern: str) -> DataFrame:
    return hashes.where(glob_match(F.col("field"), pattern))


def ttl_reply(ttl_ms: Column, there: Column, now_ms: int, unit_ms: int = 1000) -> Column:
    """-2 without the field, -1 without a deadline, else the time left in whole units."""
    return F.when(~there, -2).when(ttl_ms == 0, -1).otherwise(F.floor((ttl_ms - now_ms) / unit_ms)).cast("bigint")


def httl(hashes: DataFrame, requests: DataFrame, now_ms: int, unit_ms: int = 1000, absolute: bool = False) -> DataFrame:
    """HTTL, HPTTL, HEXPIRETIME, HPEXPIRETIME: (seq, key, field, reply)."""
    found = requests.join(hashes.select("key", "field", "ttl_ms"), ["key", "field"], "left")
    return found.select("seq", "key", "field", ttl_reply(F.coalesce("ttl_ms", F.lit(0)), F.col("ttl_ms").isNotNull(), 0 if absolute else now_ms, unit_ms).alias("reply"))


def hexpire(hashes: DataFrame, requests: DataFrame, now_ms: int, condition: str | None = None) -> DataFrame:
    """(key, field, deadline, reply) of requests (key, field, deadline): -2 no field, 0 condition failed,
    2 deleted as the deadline is past, 1 set. NX, XX, GT, LT; no deadline counts as infinite."""
    found = requests.join(hashes.select("key", "field", "ttl_ms"), ["key", "field"], "left")
    old, new = F.col("ttl_ms"), F.col("deadline")
    passed = {None: F.lit(True), "NX": old == 0, "XX": old != 0, "GT": (old != 0) & (new > old), "LT": (old == 0) | (new < old)}[condition]
    reply = F.when(old.isNull(), -2).when(~passed, 0).when(new <= now_ms, 2).otherwise(1).cast("bigint")
    return found.select("key", "field", "deadline", reply.alias("reply"))


def hpersist(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    found = requests.join(hashes.select("key", "field", "ttl_ms"), ["key", "field"], "left")
    reply = F.when(F.col("ttl_ms").isNull(), -2).when(F.col("ttl_ms") == 0, -1).otherwise(1).cast("bigint")
    return found.select("key", "field", reply.alias("reply"))


def restamp(hashes: DataFrame, outcome: DataFrame) -> DataFrame:
    """The hashes after HEXPIRE (rows of reply 1 get the deadline, of reply 2 go)."""
    step = hashes.join(outcome.where(F.col("reply").isin(1, 2)), ["key", "field"], "left").where(F.coalesce(F.col("reply") != 2, F.lit(True)))
    return step.withColumn("ttl_ms", F.coalesce("deadline", "ttl_ms")).select(*hashes.columns)


def hgetex(hashes: DataFrame, requests: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(key, field, value) read, and the hashes after: deadlines of requests (key, field, deadline) apply; 0 clears, past ones delete."""
    step = hashes.join(requests.select("key", "field", "deadline"), ["key", "field"], "left")
    read = step.where(F.col("deadline").isNotNull()).select("key", "field", "value")
    left = step.where(F.col("deadline").isNull() | (F.col("deadline") == 0) | (F.col("deadline") > now_ms))
    return read, left.withColumn("ttl_ms", F.coalesce("deadline", "ttl_ms")).select(*hashes.columns)
