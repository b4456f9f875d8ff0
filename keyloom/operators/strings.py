"""Strings and counters (key, value). Requests carry ``seq``, their place in the request list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalars import render_double


def get(strings: DataFrame, *keys: str) -> DataFrame:
    return strings.where(F.col("key").isin(*keys)).select("key", "value")


def mget(strings: DataFrame, requests: DataFrame) -> DataFrame:
    """(seq, key, value): one row for each request, null where the key is missing."""
    return requests.join(strings.select("key", "value"), "key", "left").select("seq", "key", "value")


def strlen(strings: DataFrame, requests: DataFrame) -> DataFrame:
    return mget(strings, requests).select("seq", "key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint").alias("length"))


def set_values(strings: DataFrame, writes: DataFrame, condition: str | None = None) -> DataFrame:
    """SET and MSET: the last write (by ``seq``) of each key wins; ``condition`` is NX, XX or None.

    With NX the first write of a key wins, as later ones find it present.
    """
    pick = F.min_by if condition == "NX" else F.max_by
    new = writes.groupBy("key").agg(pick("value", "seq").alias("value"))
    if condition:
        new = new.join(strings.select("key"), "key", "left_anti" if condition == "NX" else "left_semi")
    return strings.select("key", "value").join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


def setnx(strings: DataFrame, writes: DataFrame) -> DataFrame:
    """(key, reply): 1 where the key was absent."""
    old = strings.select("key").distinct().withColumn("__there", F.lit(1))
    return writes.select("key").distinct().join(old, "key", "left").select("key", F.when(F.col("__there").isNull(), 1).otherwise(0).cast("bigint").alias("reply"))


def msetnx(strings: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, key, value) of the requests none of whose keys exists."""
    there = requests.join(strings.select("key").distinct(), "key", "left_semi").select("req").distinct()
    return requests.join(there, "req", "left_anti").select("req", "key", "value")


def getset(strings: DataFrame, writes: DataFrame) -> DataFrame:
    """(key, old, value)."""
    new = writes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return new.join(strings.select("key", F.col("value").alias("old")), "key", "left").select("key", "old", "value")


def getdel(strings: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was read, and what remains."""
    return strings.join(keys, "key", "left_semi"), strings.join(keys, "key", "left_anti")


def append(strings: DataFrame, patches: DataFrame) -> DataFrame:
    """(key, value, length): patches (key, seq, patch) joined on in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "patch")))
    added = patches.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["patch"]), "").alias("__more"))
    value = F.concat(F.coalesce("value", F.lit("")), "__more")
    return added.join(strings.select("key", "value"), "key", "left").select("key", value.alias("value"), F.octet_length(value).cast("bigint").alias("length"))


def getrange(value: Column, start: int, end: int) -> Column:
    """Inclusive byte range; negatives count from the end; out of range is cut."""
    raw = value.cast("binary")
    n = F.octet_length(value)
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    return F.when(low > high, F.lit("").cast("binary")).otherwise(F.substring(raw, (low + 1).cast("int"), (high - low + 1).cast("int"))).cast("string")


def setrange(value: Column, offset: int, patch: str) -> Column:
    """Overwrite bytes from ``offset``, filling a gap with zero bytes."""
    raw, data = F.coalesce(value, F.lit("")).cast("binary"), F.lit(patch).cast("binary")
    size = len(patch.encode())
    head = F.when(F.octet_length(raw) >= offset, F.substring(raw, 1, offset)).otherwise(F.rpad(raw, offset, F.lit(b"\0")))
    if not size:
        return raw
    return F.concat(head, data, F.substring(raw, offset + size + 1, 2**31 - 1))


def incrby(strings: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, value, error): deltas (key, delta) added in 64 bits; an overflow or a value that is no
    whole number is an error and leaves no value."""
    sums = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("__d"))
    step = sums.join(strings.select("key", F.col("value").alias("__v")), "key", "left")
    old = F.when(F.col("__v").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("__v").try_cast("bigint"))
    total = F.coalesce(old.cast("decimal(38,0)"), F.lit(None)) + F.col("__d")
    value = total.try_cast("bigint")
    return step.select("key", value.alias("value"), value.isNull().alias("error"))


def incrbyfloat(strings: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, value text): float sums, whole results without a fraction, nothing for infinite results."""
    sums = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("double")).alias("__d"))
    step = sums.join(strings.select("key", F.col("value").alias("__v")), "key", "left")
    total = F.coalesce(F.col("__v").try_cast("double"), F.when(F.col("__v").isNull(), 0.0)) + F.col("__d")
    return step.select("key", F.when(~F.isnan(total) & (F.abs(total) < float("inf")), render_double(total)).alias("value"))


def setex(strings: DataFrame, writes: DataFrame) -> DataFrame:
    """SETEX, PSETEX and SET with EX, PX, EXAT, PXAT: writes (key, value, seq, deadline_ms) set value and deadline.

    ``strings`` has (key, value, ttl_ms); a deadline that is not positive is refused.
    """
    new = writes.where(F.col("deadline_ms") > 0).groupBy("key").agg(F.max_by(F.struct("value", "deadline_ms"), "seq").alias("__w"))
    kept = strings.select("key", "value", "ttl_ms").join(new.select("key"), "key", "left_anti")
    return kept.unionByName(new.select("key", "__w.value", F.col("__w.deadline_ms").cast("bigint").alias("ttl_ms")))


def getex(strings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is read, and the strings after: requests (key, deadline_ms), where 0 clears the deadline (PERSIST)."""
    step = strings.join(requests, "key", "left")
    read = step.where(F.col("deadline_ms").isNotNull()).select("key", "value")
    return read, step.select("key", "value", F.coalesce("deadline_ms", "ttl_ms").cast("bigint").alias("ttl_ms"))


def set_keepttl(strings: DataFrame, writes: DataFrame) -> DataFrame:
    """SET with KEEPTTL: new values under the deadlines that are there."""
    new = writes.groupBy("key").agg(F.max_by("value", "seq").alias("__v"))
    step = strings.select("key", "value", "ttl_ms").join(new, "key", "full_outer")
    return step.select("key", F.coalesce("__v", "value").alias("value"), F.coalesce("ttl_ms", F.lit(0)).cast("bigint").alias("ttl_ms"))
