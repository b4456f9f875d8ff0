"""Sets (key, member) and their algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.patterns import glob_match


def sadd(sets: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets after, and (key, added)."""
    new = writes.select("key", "member").distinct().join(sets.select("key", "member"), ["key", "member"], "left_anti")
    count = writes.select("key").distinct().join(new.groupBy("key").agg(F.count("*").alias("added")), "key", "left")
    return sets.select("key", "member").unionByName(new), count.select("key", F.coalesce("added", F.lit(0)).alias("added"))


def srem(sets: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = sets.join(removals.select("key", "member").distinct(), ["key", "member"], "left_semi")
    return sets.join(removals.select("key", "member"), ["key", "member"], "left_anti"), gone.groupBy("key").agg(F.count("*").alias("removed"))


def scard(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count("*").alias("size"))


def smembers(sets: DataFrame) -> DataFrame:
    """(key, members) in byte order."""
    return sets.groupBy("key").agg(F.array_sort(F.collect_set("member")).alias("members"))


def smismember(sets: DataFrame, requests: DataFrame) -> DataFrame:
    """(seq, key, member, reply): 1 or 0 for each request."""
    there = sets.select("key", "member").withColumn("__t", F.lit(1))
    return requests.join(there, ["key", "member"], "left").select("seq", "key", "member", F.coalesce("__t", F.lit(0)).cast("bigint").alias("reply"))


def _nth():
    return F.row_number().over(W.partitionBy("key").orderBy("member"))


def spop(sets: DataFrame, count: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first ``count`` members of each key in byte order, and what remains."""
    step = sets.withColumn("__n", _nth())
    return step.where(F.col("__n") <= count).drop("__n"), step.where(F.col("__n") > count).drop("__n")


def srandmember(sets: DataFrame, count: int) -> DataFrame:
    """(key, nth, member): the first members; a negative count repeats them in a cycle to its length."""
    if count >= 0:
        return sets.withColumn("nth", _nth()).where(F.col("nth") <= count).select("key", "nth", "member")
    step = sets.withColumns({"nth": _nth(), "__size": F.count("*").over(W.partitionBy("key"))})
    again = F.sequence(F.col("nth").cast("int"), F.lit(-count), F.col("__size").cast("int"))
    return step.where(F.col("nth") <= -count).select("key", F.explode(again).alias("nth"), "member")


def sscan(sets: DataFrame, pattern: str) -> DataFrame:
    return sets.where(glob_match(F.col("member"), pattern))


def smove(sets: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets after moves (src, dst, member), and (src, dst, member, reply)."""
    there = sets.select(F.col("key").alias("src"), "member").withColumn("__t", F.lit(1))
    tried = moves.join(there, ["src", "member"], "left").select("src", "dst", "member", F.coalesce("__t", F.lit(0)).cast("bigint").alias("reply"))
    done = tried.where("reply = 1")
    left = sets.join(done.select(F.col("src").alias("key"), "member"), ["key", "member"], "left_anti")
    return left.unionByName(done.select(F.col("dst").alias("key"), "member")).distinct(), tried


def _of(sets: DataFrame, key: str) -> DataFrame:
    return sets.where(F.col("key") == key).select("member")


def sunion(sets: DataFrame, *keys: str) -> DataFrame:
    return sets.where(F.col("key").isin(*keys)).select("member").distinct()


def sinter(sets: DataFrame, *keys: str) -> DataFrame:
    """Members of every key, by one count a member rather than a chain of joins."""
    distinct = sets.where(F.col("key").isin(*keys)).select("key", "member").distinct()
    return distinct.groupBy("member").agg(F.count("*").alias("__n")).where(F.col("__n") == len(set(keys))).select("member")


def sdiff(sets: DataFrame, first: str, *others: str) -> DataFrame:
    """Members of the first key that no other has, in one pass over the keys concerned."""
    rows = sets.where(F.col("key").isin(first, *others)).groupBy("member").agg(
        F.bool_or(F.col("key") == first).alias("__in"), F.bool_or(F.col("key").isin(*[k for k in others]) if others else F.lit(False)).alias("__out")
    )
    return rows.where("__in AND NOT __out").select("member")


def sintercard(sets: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    count = sinter(sets, *keys).agg(F.count("*").alias("size"))
    return count.select(F.least("size", F.lit(limit)).alias("size")) if limit else count


def store(sets: DataFrame, members: DataFrame, dst: str) -> DataFrame:
    """The *STORE forms: ``dst`` holds exactly ``members``."""
    return sets.select("key", "member").where(F.col("key") != dst).unionByName(members.select(F.lit(dst).alias("key"), "member"))


def algebra_by_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, union, inter, diff): sizes for many pairs of keys at once, from set sizes and common members."""
    sizes = scard(sets.select("key", "member").distinct())
    left = pairs.join(sets.select(F.col("key").alias("a"), "member").distinct(), "a")
    common = left.join(sets.select(F.col("key").alias("b"), "member").distinct(), ["b", "member"]).groupBy("a", "b").agg(F.count("*").alias("inter"))
    out = pairs.join(common, ["a", "b"], "left").join(sizes.select(F.col("key").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("key").alias("b"), F.col("size").alias("sb")), "b")
    inter = F.coalesce("inter", F.lit(0))
    return out.select("a", "b", (F.col("sa") + F.col("sb") - inter).alias("union"), inter.alias("inter"), (F.col("sa") - inter).alias("diff"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
