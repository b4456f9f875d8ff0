"""Comparing replicas: digests by bucket, differences by version, owners of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.scalars import partition_id

BUCKETS = 256
#: Fixed value: how far a remote clock may lead.
DRIFT_MS = 5000


def _hash(*of: Column | str) -> Column:
    """60 bits of md5 over the texts of some columns; any engine can recompute it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *of)), 1, 15), 16, 10).cast("bigint")


def digests(records: DataFrame) -> DataFrame:
    """(bucket, n, digest): an order-free digest of key, version and value of each bucket's records."""
    bucket = F.conv(F.substring(F.md5("key"), 1, 2), 16, 10).cast("int")
    row = _hash("key", F.col("hlc").cast("string"), F.md5("value"))
    return records.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.bit_xor(row).alias("digest"))


def diff(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): ``push`` what we have newer or they lack, ``pull`` the opposite, ``both`` where one
    version has two values. Equal records are left out."""
    cols = ["hlc", "origin", "value"]
    a = ours.select(*keys, F.struct(*cols).alias("a"))
    b = theirs.select(*keys, F.struct(*cols).alias("b"))
    va, vb = F.struct("a.hlc", "a.origin"), F.struct("b.hlc", "b.origin")
    action = (
        F.when(F.col("b").isNull(), "push").when(F.col("a").isNull(), "pull").when(va > vb, "push").when(va < vb, "pull")
        .when(~F.col("a.value").eqNullSafe(F.col("b.value")), "both")
    )
    return a.join(b, keys, "full_outer").withColumn("action", action).where(F.col("action").isNotNull()).select(*keys, "action")


def changed_buckets(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Buckets whose digests differ, so that only these need ``diff``."""
    a = digests(ours).select("bucket", F.struct("n", "digest").alias("a"))
    b = digests(theirs).select("bucket", F.struct("n", "digest").alias("b"))
    return a.join(b, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def owners(nodes: list[str], partitions: DataFrame, replicas: int) -> DataFrame:
    """(pid, node, place): rendezvous hashing ranks all nodes for each partition.

    The node list is a cluster's, short and given by the caller; it rides along as a literal array.
    """
    ranked = F.array_sort(
        F.transform(F.array(*map(F.lit, nodes)), lambda n: F.struct((-_hash(n, F.col("pid").cast("string"))).alias("h"), n.alias("node")))
    )
    return partitions.select("pid", F.posexplode(F.slice(ranked, 1, replicas)).alias("place", "r")).select("pid", F.col("r.node").alias("node"), "place")


def clock(steps: DataFrame, drift_ms: int = DRIFT_MS) -> DataFrame:
    """``steps`` (node, seq, wall_ms, remote) with ``hlc``, each node's clock after each step.

    A step without ``remote`` sends: the clock is past its last value and not behind the wall. One with it
    receives: the clock is past its last value and past the remote one, which counts for no more than
    ``drift_ms`` ahead of the wall.
    """
    line = W.partitionBy("node").orderBy("seq")
    limit = F.shiftleft(F.col("wall_ms") + drift_ms, 16)
    least = F.when(F.col("remote").isNull(), F.shiftleft("wall_ms", 16)).otherwise(F.least("remote", limit) + 1)
    nth = F.row_number().over(line).cast("bigint")
    return steps.withColumn("__n", nth).withColumn("hlc", F.col("__n") + F.max(least - F.col("__n")).over(line)).drop("__n")


def partition(records: DataFrame, *ids: int) -> DataFrame:
    """The records of some partitions, as a node that joins copies them."""
    return records.where(partition_id(F.col("key")).isin(*ids))
