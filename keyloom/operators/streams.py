"""Streams (key, ms, seq, fields): entries in the order of their id (ms, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID = ("ms", "seq")


def entry_id(text: str, low: bool = True) -> tuple[int, int]:
    """``-``, ``+``, ``ms`` (with the least or greatest seq) or ``ms-seq``."""
    if text == "-":
        return 0, 0
    if text == "+":
        return 2**63 - 1, 2**63 - 1
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else (0 if low else 2**63 - 1)


def _id(ms: int, seq: int) -> Column:
    return F.struct(F.lit(ms).cast("bigint").alias("ms"), F.lit(seq).cast("bigint").alias("seq"))


def _order(rev: bool = False):
    return W.partitionBy("key").orderBy(*[F.col(c).desc() if rev else F.col(c).asc() for c in ID])


def xadd(streams: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The streams after, and the refused entries: an id must exceed all before it in its key.

    Entries (key, n, ms, seq, fields) come in the order of ``n``. An entry stands if its id is greater
    than the stream's last and than every id before it in the batch.
    """
    last = streams.groupBy("key").agg(F.max(F.struct(*ID)).alias("__last"))
    before = F.max(F.struct(*ID)).over(W.partitionBy("key").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    step = entries.join(last, "key", "left").withColumn("__before", F.greatest(before, "__last"))
    ok = F.coalesce(F.struct(*ID) > F.col("__before"), F.lit(True))
    step = step.withColumn("__ok", ok)
    return streams.unionByName(step.where("__ok").select(*streams.columns)), step.where(~F.col("__ok")).select("key", "n", *ID)


def xlen(streams: DataFrame) -> DataFrame:
    return streams.groupBy("key").agg(F.count("*").alias("length"))


def xrange(streams: DataFrame, low: str = "-", high: str = "+", count: int | None = None, rev: bool = False) -> DataFrame:
    """Inclusive range of ids; ``count`` entries of each key, from the end if ``rev``."""
    (a, b), (c, d) = entry_id(low), entry_id(high, low=False)
    rows = streams.where((F.struct(*ID) >= _id(a, b)) & (F.struct(*ID) <= _id(c, d)) & F.col("ms").between(a, c))
    if count is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(_order(rev))).where(F.col("__n") <= count).drop("__n")


def xread(streams: DataFrame, cursors: DataFrame, count: int | None = None) -> DataFrame:
    """Entries after each key's cursor (key, after_ms, after_seq), strictly."""
    rows = streams.join(cursors, "key").where(F.struct(*ID) > F.struct(F.col("after_ms").alias("ms"), F.col("after_seq").alias("seq"))).select(*streams.columns)
    if count is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(_order())).where(F.col("__n") <= count).drop("__n")


def xdel(streams: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = streams.join(ids.select("key", *ID).distinct(), ["key", *ID], "left_semi")
    return streams.join(ids.select("key", *ID), ["key", *ID], "left_anti"), gone.groupBy("key").agg(F.count("*").alias("removed"))


def xtrim(streams: DataFrame, maxlen: int) -> DataFrame:
    """The newest ``maxlen`` entries of each key."""
    return streams.withColumn("__n", F.row_number().over(_order(True))).where(F.col("__n") <= maxlen).drop("__n")


def xinfo(streams: DataFrame) -> DataFrame:
    """(key, length, first_ms, first_seq, last_ms, last_seq)."""
    rows = streams.groupBy("key").agg(F.count("*").alias("length"), F.min(F.struct(*ID)).alias("a"), F.max(F.struct(*ID)).alias("z"))
    return rows.select("key", "length", F.col("a.ms").alias("first_ms"), F.col("a.seq").alias("first_seq"), F.col("z.ms").alias("last_ms"), F.col("z.seq").alias("last_seq"))


def xsetid(heads: DataFrame, requests: DataFrame, streams: DataFrame) -> DataFrame:
    """(key, last_ms, last_seq, ok): a new last id may not be smaller than the newest entry's."""
    newest = streams.groupBy("key").agg(F.max(F.struct(*ID)).alias("__top"))
    step = heads.select("key").join(requests, "key").join(newest, "key", "left")
    ok = F.coalesce(F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq")) >= F.col("__top"), F.lit(True))
    return step.select("key", "last_ms", "last_seq", ok.alias("ok"))


def xadd_auto(streams: DataFrame, entries: DataFrame, node: int = 0) -> DataFrame:
    """Entries (key, n, ms, fields) with ids of their own: their millisecond, raised to the stream's last where
    the clock is behind, and a running number that carries the node, so writers never share an id."""
    last = streams.groupBy("key").agg(F.max("ms").alias("__last"))
    order = W.partitionBy("key").orderBy("n")
    step = entries.join(last, "key", "left")
    ms = F.greatest(F.max("ms").over(order.rowsBetween(W.unboundedPreceding, 0)), F.coalesce("__last", F.lit(0)))
    step = step.withColumn("ms", ms)
    nth = F.row_number().over(W.partitionBy("key", "ms").orderBy("n"))
    return step.select("key", "ms", (F.lit(node << 20).cast("bigint") + nth).alias("seq"), "fields")
