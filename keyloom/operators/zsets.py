"""Sorted sets (key, member, score): ranges, ranks, pops and weighted algebra.

Members of equal score stand in byte order; ranks are row numbers, never shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.patterns import glob_match
from keyloom.functions.scalars import index_bounds, lex_between, score_between


def _order(rev: bool = False, by: tuple[str, ...] = ("score", "member")) -> list[Column]:
    return [F.col(c).desc() if rev else F.col(c).asc() for c in by]


def _place(rev: bool = False, by: tuple[str, ...] = ("score", "member")) -> Column:
    """1-based position. Filters compare it as it is: only then is each key cut before the shuffle."""
    return F.row_number().over(W.partitionBy("key").orderBy(*_order(rev, by)))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("key", (F.col("__n") - 1).alias("rank"), "member", "score")


def _nth(rev: bool = False, by: tuple[str, ...] = ("score", "member")) -> Column:
    return F.row_number().over(W.partitionBy("key").orderBy(*_order(rev, by))) - 1


def zadd(zsets: DataFrame, writes: DataFrame, condition: str | None = None, compare: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The sets after writes (key, member, score, seq), and (key, added, changed).

    ``condition`` NX or XX, ``compare`` GT or LT; GT and LT reduce a batch to its greatest or least score.
    """
    if condition == "NX" and compare:
        raise ValueError("GT, LT, and/or NX options at the same time are not compatible")
    pick = {"GT": F.max("score"), "LT": F.min("score"), None: F.min_by("score", "seq") if condition == "NX" else F.max_by("score", "seq")}[compare]
    new = writes.groupBy("key", "member").agg(pick.alias("__new"))
    both = zsets.select("key", "member", "score").join(new, ["key", "member"], "full_outer")
    old, now = F.col("score"), F.col("__new")
    ok = now.isNotNull()
    ok &= {"NX": old.isNull(), "XX": old.isNotNull(), None: F.lit(True)}[condition]
    ok &= {"GT": old.isNull() | (now > old), "LT": old.isNull() | (now < old), None: F.lit(True)}[compare]
    step = both.withColumns({"__ok": F.coalesce(ok, F.lit(False)), "__old": old})
    counts = step.where(now.isNotNull()).groupBy("key").agg(
        F.count_if(F.col("__ok") & F.col("__old").isNull()).alias("added"), F.count_if(F.col("__ok") & (F.col("__old") != F.col("__new"))).alias("changed")
    )
    after = step.select("key", "member", F.when(F.col("__ok"), F.col("__new")).otherwise(F.col("score")).alias("score")).where(F.col("score").isNotNull())
    return after, counts


def zincrby(zsets: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, member, score) of deltas (key, member, delta) added; an absent member starts at 0."""
    sums = deltas.groupBy("key", "member").agg(F.sum("delta").alias("__d"))
    return sums.join(zsets.select("key", "member", "score"), ["key", "member"], "left").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.col("__d")).alias("score"))


def zmscore(zsets: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(zsets.select("key", "member", "score"), ["key", "member"], "left").select("seq", "key", "member", "score")


def zcard(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count("*").alias("size"))


def zrem(zsets: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = zsets.join(removals.select("key", "member").distinct(), ["key", "member"], "left_semi")
    return zsets.join(removals.select("key", "member"), ["key", "member"], "left_anti"), gone.groupBy("key").agg(F.count("*").alias("removed"))


def zrange(zsets: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """(key, rank, member, score): an inclusive range of positions.

    A range from the front needs only each key's first rows, which the plan cuts before the shuffle.
    """
    step = zsets.withColumn("__n", _place(rev))
    if start >= 0 and stop >= 0:
        return _ranked(step.where((F.col("__n") <= stop + 1) & (F.col("__n") > start)))
    step = step.withColumn("rank", F.col("__n") - 1).withColumn("__size", F.count("*").over(W.partitionBy("key")))
    low, high = index_bounds(start, stop, F.col("__size"))
    return step.where((F.col("rank") >= low) & (F.col("rank") <= high)).select("key", "rank", "member", "score")


def _limited(rows: DataFrame, rev: bool, offset: int, count: int, by: tuple[str, ...]) -> DataFrame:
    """Position is counted within what the range selected; a negative count means all."""
    step, skip = rows.withColumn("__n", _place(rev, by)), max(offset, 0)
    test = F.col("__n") > skip
    return _ranked(step.where((F.col("__n") <= skip + count) & test if count >= 0 else test))


def zrangebyscore(zsets: DataFrame, low: str, high: str, rev: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    return _limited(zsets.where(score_between(F.col("score"), low, high)), rev, offset, count, ("score", "member"))


def zrangebylex(zsets: DataFrame, low: str, high: str, rev: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    return _limited(zsets.where(lex_between(F.col("member"), low, high)), rev, offset, count, ("member",))


def zrank(zsets: DataFrame, requests: DataFrame, rev: bool = False) -> DataFrame:
    """(seq, key, member, rank, score); null where absent. Only the requested keys are ranked."""
    own = zsets.join(requests.select("key").distinct(), "key", "left_semi").withColumn("rank", _nth(rev).cast("bigint"))
    return requests.join(own.select("key", "member", "rank", "score"), ["key", "member"], "left").select("seq", "key", "member", "rank", "score")


def zcount(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.groupBy("key").agg(F.count_if(score_between(F.col("score"), low, high)).alias("n"))


def zlexcount(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.groupBy("key").agg(F.count_if(lex_between(F.col("member"), low, high)).alias("n"))


def zpop(zsets: DataFrame, count: int = 1, most: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN and ZPOPMAX: (key, rank, member, score) popped, and what remains."""
    step = zsets.withColumn("__n", _place(most))
    return _ranked(step.where(F.col("__n") <= count)), step.where(F.col("__n") > count).select("key", "member", "score")


def zmpop(zsets: DataFrame, keys: list[str], count: int = 1, most: bool = False) -> DataFrame:
    """Pops from the first key of the list that is not empty."""
    place = F.element_at(F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))]), F.col("key"))
    own = zsets.where(F.col("key").isin(*keys)).withColumn("__p", place)
    first = own.groupBy().agg(F.min("__p").alias("__f"))
    return zpop(own.join(F.broadcast(first), F.col("__p") == F.col("__f"), "left_semi"), count, most)[0]  # one row


def zrandmember(zsets: DataFrame, count: int) -> DataFrame:
    """(key, nth, member): the first by score; a negative count repeats them in a cycle."""
    if count >= 0:
        return zsets.withColumn("nth", _place()).where(F.col("nth") <= count).select("key", "nth", "member")
    step = zsets.withColumns({"nth": _place(), "__size": F.count("*").over(W.partitionBy("key"))})
    again = F.sequence(F.col("nth").cast("int"), F.lit(-count), F.col("__size").cast("int"))
    return step.where(F.col("nth") <= -count).select("key", F.explode(again).alias("nth"), "member")


def store(zsets: DataFrame, rows: DataFrame, dst: str) -> DataFrame:
    """ZRANGESTORE and the other *STORE forms: ``dst`` holds exactly ``rows``."""
    return zsets.select("key", "member", "score").where(F.col("key") != dst).unionByName(rows.select(F.lit(dst).alias("key"), "member", "score"))


def zremrange(zsets: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """ZREMRANGEBYSCORE and BYLEX: what remains, and (key, removed), for a range predicate."""
    return zsets.where(~inside), zsets.groupBy("key").agg(F.count_if(inside).alias("removed"))


def zremrangebyrank(zsets: DataFrame, start: int, stop: int) -> tuple[DataFrame, DataFrame]:
    gone = zrange(zsets, start, stop).select("key", "member")
    return zsets.join(gone, ["key", "member"], "left_anti"), gone.groupBy("key").agg(F.count("*").alias("removed"))


AGGREGATES = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def _weighted(zsets: DataFrame, keys: list[str], weights: list[float] | None) -> DataFrame:
    table = F.create_map(*[x for k, w in zip(keys, weights or [1.0] * len(keys), strict=True) for x in (F.lit(k), F.lit(float(w)))])
    return zsets.where(F.col("key").isin(*keys)).select("key", "member", (F.col("score") * F.element_at(table, F.col("key"))).alias("score"))


def zunion(zsets: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """(member, score); weights apply before the aggregate."""
    return _weighted(zsets, keys, weights).groupBy("member").agg(AGGREGATES[aggregate]("score").alias("score"))


def zinter(zsets: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    rows = _weighted(zsets, keys, weights).groupBy("member").agg(AGGREGATES[aggregate]("score").alias("score"), F.count("*").alias("__n"))
    return rows.where(F.col("__n") == len(keys)).select("member", "score")


def zdiff(zsets: DataFrame, first: str, *others: str) -> DataFrame:
    own = F.col("key") == first
    rows = zsets.where(F.col("key").isin(first, *others)).groupBy("member").agg(F.max(F.when(own, F.col("score"))).alias("score"), F.bool_or(~own).alias("__out"))
    return rows.where(F.col("score").isNotNull() & ~F.col("__out")).select("member", "score")


def zintercard(zsets: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    count = zinter(zsets, keys).agg(F.count("*").alias("size"))
    return count.select(F.least("size", F.lit(limit)).alias("size")) if limit else count


def zscan(zsets: DataFrame, pattern: str) -> DataFrame:
    return zsets.where(glob_match(F.col("member"), pattern))
