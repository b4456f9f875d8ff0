"""Distributed budgets: capacity escrowed to nodes, reservations against a node's share.

Admission is sequential by nature: a refused request consumes nothing, so a running sum is wrong.
Each (key, node) ledger is one group, read in order and folded with one number of state, in Arrow
batches, so a group need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, EXPIRED, FOLDED = 0, 1, 2


def even_split(amount: Column, nth: Column, n: Column) -> Column:
    """A node's part of an amount: the remainder goes to the first nodes, one unit each."""
    return F.floor(amount / n).cast("bigint") + F.when(nth < amount % n, 1).otherwise(0)


def create(budgets: DataFrame) -> DataFrame:
    """(key, node, alloc) of budgets (key, capacity, nodes): nodes sorted, each once."""
    nodes = F.array_sort(F.array_distinct("nodes"))
    rows = budgets.select("key", "capacity", F.size(nodes).alias("n"), F.posexplode(nodes).alias("nth", "node"))
    return rows.select("key", "node", even_split(F.col("capacity"), F.col("nth"), F.col("n")).alias("alloc"))


def topup(shares: DataFrame, amounts: DataFrame) -> DataFrame:
    """Shares after amounts (key, amount[, node]): to one node, or evenly."""
    nth = F.row_number().over(W.partitionBy("key").orderBy("node")) - 1
    step = shares.withColumns({"__i": nth, "__n": F.count("*").over(W.partitionBy("key"))}).join(amounts.withColumnRenamed("node", "__to") if "node" in amounts.columns else amounts.withColumn("__to", F.lit(None).cast("string")), "key", "left")
    more = F.when(F.col("amount").isNull(), 0).when(F.col("__to").isNull(), even_split(F.col("amount"), F.col("__i"), F.col("__n"))).when(F.col("__to") == F.col("node"), F.col("amount")).otherwise(0)
    return step.select("key", "node", (F.col("alloc") + more).cast("bigint").alias("alloc"))


def reserve(requests: DataFrame, shares: DataFrame) -> DataFrame:
    """(key, node, seq, amount, granted): requests (key, node, seq, amount) against each node's share.

    A request is granted if what is outstanding and its amount fit the share.
    """
    known = requests.join(shares, ["key", "node"]).select("key", "node", "seq", F.col("amount").cast("bigint").alias("amount"), "alloc")
    # A window, as it asks for whole sorted ledgers: a repartition is dropped after a join on the same columns, which
    # Spark may then turn into a broadcast that deals a ledger to many tasks.
    dealt = known.withColumn("nth", F.row_number().over(W.partitionBy("key", "node").orderBy("seq")))

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for b in batches:
            granted = []
            for nth, amount, alloc in zip(b["nth"], b["amount"], b["alloc"], strict=True):
                if nth == 1:
                    used = 0
                ok = amount >= 0 and used + amount <= alloc
                used += amount if ok else 0
                granted.append(ok)
            yield b[["key", "node", "seq", "amount"]].assign(granted=granted)

    return dealt.mapInPandas(admit, "key string, node string, seq long, amount long, granted boolean")


def settle(tokens: DataFrame, requests: DataFrame) -> DataFrame:
    """BG.COMMIT and BG.RELEASE: (key, token, credited, status) of requests (key, token, spent, at_ms).

    Tokens have amount, drawn, rank and deadline_ms; ``spent`` null releases, which credits what was not drawn.
    """
    step = requests.join(tokens, ["key", "token"], "left")
    spent = F.coalesce("spent", "drawn")
    status = (
        F.when(F.col("amount").isNull(), "NOTOKEN").when(F.col("rank") == FOLDED, "TOKENUSED").when((F.col("rank") == EXPIRED) | (F.col("at_ms") >= F.col("deadline_ms")), "TOKENEXPIRED")
        .when(spent > F.col("amount"), "OVERSPENT").otherwise("OK")
    )
    return step.withColumn("status", status).select("key", "token", F.when(F.col("status") == "OK", F.col("amount") - spent).alias("credited"), "status")


def draw(draws: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, token, seq, amount, granted): cumulative draws of each token up to its amount."""
    ledger = tokens.select("key", F.col("token").alias("node"), F.col("amount").alias("alloc"))
    return reserve(draws.withColumnRenamed("token", "node"), ledger).withColumnRenamed("node", "token")


def info(shares: DataFrame, slots: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, capacity, outstanding, available, open_tokens, open_amount); sums are exact decimals."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")) if isinstance(c, str) else F.sum(c.cast("decimal(38,0)"))
    cap = shares.groupBy("key").agg(wide("alloc").alias("capacity"))
    out = slots.groupBy("key").agg(wide(F.col("granted") - F.col("returned")).alias("outstanding"))
    live = tokens.where(F.col("rank") < FOLDED).groupBy("key").agg(F.count("*").alias("open_tokens"), wide(F.col("amount") - F.least("spent", "amount")).alias("open_amount"))
    zero = F.lit(0)
    joined = cap.join(out, "key", "left").join(live, "key", "left").withColumn("outstanding", F.coalesce("outstanding", zero))
    return joined.select("key", "capacity", "outstanding", (F.col("capacity") - F.col("outstanding")).alias("available"), F.coalesce("open_tokens", zero).alias("open_tokens"), F.coalesce("open_amount", zero).alias("open_amount"))


def reclaim(shares: DataFrame, slots: DataFrame, tokens: DataFrame, node: str) -> DataFrame:
    """(key, node, alloc) after a node's unused share went to the others, in even parts."""
    used = tokens.where(F.col("node") == node).groupBy("key").agg(F.sum(F.when(F.col("rank") == FOLDED, F.col("spent")).otherwise(F.col("amount"))).alias("__t"))
    held = slots.where(F.col("node") == node).groupBy("key").agg(F.sum(F.col("granted") - F.col("returned")).alias("__s"))
    target = shares.where(F.col("node") == node).select("key", F.col("alloc").alias("__a")).join(used, "key", "left").join(held, "key", "left")
    consumed = F.least("__a", F.greatest(F.coalesce("__t", F.lit(0)), F.coalesce("__s", F.lit(0)))).cast("bigint")
    target = target.select("key", consumed.alias("__keep"), (F.col("__a") - consumed).alias("amount"))
    others = topup(shares.where(F.col("node") != node), target.select("key", "amount"))
    return others.unionByName(target.select("key", F.lit(node).alias("node"), F.col("__keep").alias("alloc")))


def window_of(ms: Column, period_ms: int) -> Column:
    """The window of WINDOW budgets: a count of whole periods."""
    return F.floor(ms / period_ms).cast("bigint")
