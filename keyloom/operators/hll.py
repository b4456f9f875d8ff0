"""HyperLogLog registers: (key, bucket, rank), 16,384 buckets.

A 64-bit hash gives the bucket by its low 14 bits and the rank by the leading zeros of the rest.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 14
M = 1 << P


def md5_hash(element: Column) -> tuple[Column, Column]:
    """(bucket, 50 remaining bits) of an element's md5, as any SQL engine can compute them."""
    digits = F.md5(element)
    low = F.conv(F.substring(digits, 1, 4), 16, 10).cast("bigint")
    return (low % M).cast("int"), F.conv(F.substring(digits, 5, 13), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << 50) - 1))


def xxh3_bucket_rank(element: Column | str) -> Column:
    """Bucket and rank of the 64-bit xxh3 of an element's bytes."""

    @F.pandas_udf("bucket int, rank int")
    def run(elements: pd.Series) -> pd.DataFrame:
        h = [xxhash.xxh3_64_intdigest((e or "").encode()) for e in elements]
        return pd.DataFrame({"bucket": [x & (M - 1) for x in h], "rank": [64 - P - (x >> P).bit_length() + 1 for x in h]}).astype("int32")

    return run(element)


def rank_of(rest: Column, bits: int = 64 - P) -> Column:
    """Leading zeros of a ``bits``-bit number, and one."""
    return F.when(rest == 0, bits + 1).otherwise(F.lit(bits + 1) - F.length(F.bin(rest))).cast("int")


def pfadd(elements: DataFrame, native: bool = True) -> DataFrame:
    """Registers of elements (key, element)."""
    if native:
        bucket, rest = md5_hash(F.col("element"))
        rows = elements.select("key", bucket.alias("bucket"), rank_of(rest).alias("rank"))
    else:
        rows = elements.select("key", xxh3_bucket_rank("element").alias("r")).select("key", "r.bucket", "r.rank")
    return rows.groupBy("key", "bucket").agg(F.max("rank").alias("rank"))


def pfmerge(registers: DataFrame, dst: str, *keys: str) -> DataFrame:
    own = registers.where(F.col("key").isin(*keys)) if keys else registers
    return own.groupBy("bucket").agg(F.max("rank").alias("rank")).select(F.lit(dst).alias("key"), "bucket", "rank")


def pfcount(registers: DataFrame, linear: bool = False) -> DataFrame:
    """(key, estimate): the raw estimate, or linear counting while it is small and a register is empty.

    ``linear`` counts linearly at any size while a register is empty, as the SQL of the queries does; loaded
    sketches are then estimated less well (a standard error of 2.2 % at 90,000 elements against 0.8 %).
    """
    parts = registers.groupBy("key").agg(F.sum(F.pow(F.lit(2.0), 52 - F.col("rank")).cast("decimal(38,0)")).alias("s"), F.count("*").alias("used"))
    inverse = F.col("s").cast("double") / float(1 << 52) + (M - F.col("used"))
    raw = (0.7213 / (1 + 1.079 / M)) * M * M / inverse
    empty = M - F.col("used")
    estimate = F.when((empty > 0) if linear else (raw <= 2.5 * M) & (empty > 0), M * F.log(M / empty)).otherwise(raw)
    return parts.select("key", F.floor(estimate + 0.5).cast("bigint").alias("estimate"))
