"""Lists (key, pos, value); ``pos`` orders a key's elements and may have gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.scalars import index_bounds


def _by(rev: bool = False):
    return W.partitionBy("key").orderBy(F.col("pos").desc() if rev else F.col("pos").asc())


def _indexed(lists: DataFrame) -> DataFrame:
    return lists.withColumns({"index": (F.row_number().over(_by()) - 1).cast("bigint"), "__size": F.count("*").over(W.partitionBy("key"))})


def push(lists: DataFrame, writes: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """LPUSH, RPUSH and the X forms: writes (key, seq, value) take positions beyond an end of the list."""
    ends = lists.groupBy("key").agg((F.min("pos") if left else F.max("pos")).alias("__end"))
    new = writes.join(ends, "key", "inner" if only_existing else "left")
    nth = F.row_number().over(W.partitionBy("key").orderBy("seq")).cast("bigint")
    pos = F.coalesce("__end", F.lit(0 if left else -1).cast("bigint")) + (-nth if left else nth)
    return lists.select("key", "pos", "value").unionByName(new.select("key", pos.alias("pos"), "value"))


def pop(lists: DataFrame, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, nth, value) popped, and what remains."""
    step = lists.withColumn("nth", F.row_number().over(_by(not left)))
    return step.where(F.col("nth") <= count).select("key", "nth", "value"), step.where(F.col("nth") > count).select("key", "pos", "value")


def lmpop(lists: DataFrame, keys: list[str], count: int = 1, left: bool = True) -> DataFrame:
    """Pops from the first key of the list that is not empty."""
    place = F.element_at(F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))]), F.col("key"))
    own = lists.where(F.col("key").isin(*keys)).withColumn("__p", place)
    first = own.groupBy().agg(F.min("__p").alias("__f"))
    return pop(own.join(F.broadcast(first), F.col("__p") == F.col("__f"), "left_semi"), count, left)[0]  # one row


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("length"))


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, index, value) of an inclusive index range."""
    if start >= 0 and stop >= 0:  # the first rows of each key suffice
        step = lists.withColumn("__n", F.row_number().over(_by()))
        return step.where((F.col("__n") <= stop + 1) & (F.col("__n") > start)).select("key", (F.col("__n") - 1).cast("bigint").alias("index"), "value")
    step = _indexed(lists)
    low, high = index_bounds(start, stop, F.col("__size"))
    return step.where((F.col("index") >= low) & (F.col("index") <= high)).select("key", "index", "value")


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """The lists cut to a range, their positions counted anew."""
    return lrange(lists, start, stop).select("key", F.col("index").alias("pos"), "value")


def lindex(lists: DataFrame, index: int) -> DataFrame:
    """(key, value) of every key; null where the index is out of range."""
    nth = F.row_number().over(_by(index < 0))
    want = index + 1 if index >= 0 else -index
    hit = lists.withColumn("__n", nth).where(F.col("__n") == want).select("key", "value")
    return lists.select("key").distinct().join(hit, "key", "left")


def lset(lists: DataFrame, index: int, value: Column) -> tuple[DataFrame, DataFrame]:
    """The lists after, and the keys for which the index is out of range."""
    step = _indexed(lists)
    at = F.lit(index) if index >= 0 else F.col("__size") + index
    after = step.select("key", "pos", F.when(F.col("index") == at, value).otherwise(F.col("value")).alias("value"))
    short = llen(lists).where(F.col("length") <= (index if index >= 0 else -index - 1)).select("key")
    return after, short


def lrem(lists: DataFrame, count: int, value: Column) -> DataFrame:
    """What remains after removing ``count`` elements equal to ``value``: from the head, from the tail
    if negative, all if 0."""
    equal = F.coalesce(F.col("value") == value, F.lit(False))
    if count == 0:
        return lists.where(~equal)
    nth = F.row_number().over(W.partitionBy("key", "__eq").orderBy(F.col("pos").desc() if count < 0 else F.col("pos").asc()))
    step = lists.withColumn("__eq", equal).withColumn("__n", nth)
    return step.where(~F.col("__eq") | (F.col("__n") > abs(count))).drop("__eq", "__n")


def linsert(lists: DataFrame, pivot: Column, value: Column, before: bool = True) -> DataFrame:
    """(key, index, value) with ``value`` put next to the first element equal to ``pivot``; keys without it stay."""
    hit = F.min(F.when(F.col("value") == pivot, F.col("index"))).over(W.partitionBy("key"))
    at = F.col("__at") + (0 if before else 1)
    moved = F.struct((F.col("index") + F.when(F.col("index") >= at, 1).otherwise(0)).alias("index"), "value")
    both = F.array(moved, F.struct(at.alias("index"), value.alias("value")))
    step = _indexed(lists).withColumn("__at", hit)
    return step.select("key", F.inline(F.when(F.col("index") == F.col("__at"), both).otherwise(F.array(moved))))


def lpos(lists: DataFrame, value: Column, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """(key, nth, index) of matches from the ``rank``-th on (negative: from the tail); ``count`` 0 means all."""
    if rank == 0:
        raise ValueError("RANK can't be zero")
    step = _indexed(lists)
    if maxlen:
        step = step.where(F.col("index") < maxlen if rank > 0 else F.col("index") >= F.col("__size") - maxlen)
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.col("index").desc() if rank < 0 else F.col("index").asc())) - abs(rank) + 1
    found = step.where(F.col("value") == value).withColumn("nth", nth).where(F.col("nth") >= 1)
    if count != 0:
        found = found.where(F.col("nth") <= (count or 1))
    return found.select("key", "nth", "index")


def lmove(lists: DataFrame, moves: DataFrame, from_left: bool, to_left: bool) -> tuple[DataFrame, DataFrame]:
    """The lists after one move for each (src, dst), and (src, dst, value). Sources are distinct."""
    popped, left = pop(lists.join(moves.select(F.col("src").alias("key")), "key", "left_semi"), 1, from_left)
    taken = moves.join(popped.select(F.col("key").alias("src"), "value"), "src").select("src", "dst", "value")
    others = lists.join(moves.select(F.col("src").alias("key")), "key", "left_anti").select("key", "pos", "value")
    return push(left.unionByName(others), taken.select(F.col("dst").alias("key"), F.hash("src").alias("seq"), "value"), to_left), taken


def blocking_pops(commands: DataFrame) -> DataFrame:
    """(key, seq, value): what BLPOP on a recorded log (key, seq, op, value) of RPUSHes and pops gets, however long it waits.

    A list served from its head gives its n-th element to its n-th pop, whichever came first.
    """
    nth = F.row_number().over(W.partitionBy("key", "op").orderBy("seq"))
    rows = commands.withColumn("__n", nth)
    pops, pushes = rows.where("op = 'pop'").select("key", "__n", "seq"), rows.where("op = 'push'").select("key", "__n", "value")
    return pops.join(pushes, ["key", "__n"]).select("key", "seq", "value")
