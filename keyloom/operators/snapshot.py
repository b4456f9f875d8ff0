"""What a reader sees at a chosen time: tombstones, deadlines and delete clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(ttl_ms: Column, now_ms: int) -> Column:
    """0 stands for no deadline."""
    return (ttl_ms != 0) & (F.lit(now_ms) >= ttl_ms)


def delete_clock(heads: DataFrame, now_ms: int) -> DataFrame:
    """(key, del_hlc): records up to this version are dead.

    A head that is a tombstone deletes up to its own version, one past its deadline up to the deadline.
    """
    zero = F.lit(0).cast("bigint")
    clock = F.greatest("del_hlc", F.when(F.col("tomb"), F.col("hlc")).otherwise(zero), F.when(expired(F.col("ttl_ms"), now_ms), F.shiftleft("ttl_ms", 16)).otherwise(zero))
    return heads.groupBy("key").agg(F.max(clock).alias("del_hlc"))


def visible(records: DataFrame, now_ms: int, heads: DataFrame | None = None) -> DataFrame:
    """Records that are neither tombstones, nor past their deadline, nor under their key's delete clock."""
    rows = records.where(~F.col("tomb") & ~expired(F.col("ttl_ms"), now_ms))
    if heads is None:
        return rows
    clocks = delete_clock(heads, now_ms).withColumnRenamed("del_hlc", "__clock")
    return rows.join(clocks, "key", "left").where(F.col("hlc") > F.coalesce("__clock", F.lit(0).cast("bigint"))).drop("__clock")


def expiry_sweep(records: DataFrame, now_ms: int) -> DataFrame:
    """Tombstones for records past their deadline, versioned by the deadline."""
    due = records.where(~F.col("tomb") & expired(F.col("ttl_ms"), now_ms))
    return due.withColumns({"hlc": F.shiftleft("ttl_ms", 16), "tomb": F.lit(True), "ttl_ms": F.lit(0).cast("bigint")})


def collect_garbage(records: DataFrame, now_ms: int, grace_ms: int = 3_600_000, anchors: Column | None = None) -> DataFrame:
    """Drop tombstones older than the grace time; rows that ``anchors`` marks stay, as others lean on them."""
    old = F.col("tomb") & (F.shiftright("hlc", 16) < now_ms - grace_ms)
    return records.where(~old | (anchors if anchors is not None else F.lit(False)))


def resolve_types(strings: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, type): a live string hides a collection of the same key."""
    both = strings.select("key", F.lit(0).alias("rank"), F.lit("string").alias("type")).unionByName(heads.select("key", F.lit(1).alias("rank"), "type"))
    return both.groupBy("key").agg(F.min_by("type", "rank").alias("type"))
