"""Convergent merges of record logs that many writers appended to.

Every rule is one aggregation whose result does not depend on the order of records, how they are
split into batches, or how often one arrives. Different payloads of one version should not exist; where
they do, the greatest payload wins, so that all replicas agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = ("hlc", "origin")


def version(*more: str) -> Column:
    return F.struct(*VERSION, *more)


def _orderable(records: DataFrame, columns: Sequence[str]) -> list[str]:
    """Of some columns, those whose values have an order."""
    return [f.name for f in records.schema.fields if f.name in columns and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def lww(records: DataFrame, keys: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """Last writer wins: the record of the greatest (hlc, origin) of each key.

    ``tiebreak`` columns, and then the payload's columns in their order, decide between records of one version.
    """
    rest = [c for c in records.columns if c not in keys]
    payload = [c for c in _orderable(records, rest) if c not in (*VERSION, *tiebreak)]
    best = F.max_by(F.struct(*rest), version(*tiebreak, *payload))
    return records.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def or_elements(adds: DataFrame, covers: DataFrame, keys: Sequence[str] = ("key", "elem")) -> DataFrame:
    """Observed-remove elements: (keys, value, hlc, origin, live) of elements with a live dot.

    ``adds`` has (keys, value, hlc, origin), ``covers`` (keys, hlc, origin) of dots that some removal saw.
    All dots are united and the covered ones taken away, without a cap on either, so six or more
    adds of one element merge alike in any order.
    """
    dots = adds.groupBy(*keys, *VERSION).agg(F.max("value").alias("value"))
    live = dots.join(covers.select(*keys, *VERSION).distinct(), [*keys, *VERSION], "left_anti")
    return live.groupBy(*keys).agg(F.max_by("value", version()).alias("value"), F.max(version()).alias("v"), F.count("*").alias("live")).select(
        *keys, "value", F.col("v.hlc").alias("hlc"), F.col("v.origin").alias("origin"), "live"
    )


def pn_counters(slots: DataFrame) -> DataFrame:
    """(key, value, overflow) of increment-only counters (key, base_hlc, base_origin, base, node, pos, neg).

    The newest base wins with its slots and drops older ones; each node's slot is the greatest it has
    reached. Sums are exact decimals; a sum outside 64 bits has a null value and ``overflow``.
    """
    base = ("base_hlc", "base_origin")
    per_node = slots.groupBy("key", *base, "node").agg(F.max("base").alias("base"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    per_base = per_node.groupBy("key", *base).agg(
        F.max("base").alias("base"), F.sum(F.col("pos").cast("decimal(38,0)")).alias("pos"), F.sum(F.col("neg").cast("decimal(38,0)")).alias("neg")
    )
    newest = per_base.groupBy("key").agg(F.max_by(F.struct("base", "pos", "neg"), F.struct(*base)).alias("r"))
    total = F.col("r.base").cast("decimal(38,0)") + F.col("r.pos") - F.col("r.neg")
    fits = total.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)"))
    return newest.select("key", F.when(fits, total).cast("bigint").alias("value"), (~fits).alias("overflow"))


def counter_state(slots: DataFrame) -> DataFrame:
    """(key, base_hlc, base_origin, base, slots): what a counter consists of, its nodes' slots as text in node order."""
    base = ("base_hlc", "base_origin")
    per_node = slots.groupBy("key", *base, "node").agg(F.max("base").alias("base"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    text = F.concat(F.lit("n"), F.col("node").cast("string"), F.lit(":+"), F.col("pos").cast("string"), F.lit("-"), F.col("neg").cast("string"))
    per_base = per_node.groupBy("key", *base).agg(F.max("base").alias("base"), F.array_sort(F.collect_list(F.struct("node", text.alias("t")))).alias("s"))
    newest = per_base.groupBy("key").agg(F.max_by(F.struct(*base, "base", "s"), F.struct(*base)).alias("r"))
    return newest.select("key", "r.base_hlc", "r.base_origin", "r.base", F.array_join(F.transform("r.s", lambda x: x["t"]), " ").alias("slots"))


def hll_registers(registers: DataFrame) -> DataFrame:
    """(key, bucket, rank): the greatest rank; of equal ranks the older version is kept."""
    if "hlc" not in registers.columns:
        return registers.groupBy("key", "bucket").agg(F.max("rank").alias("rank"))
    first = F.struct((-F.col("rank")).alias("r"), *VERSION)
    return registers.groupBy("key", "bucket").agg(F.min(first).alias("m")).select("key", "bucket", (-F.col("m.r")).alias("rank"), "m.hlc", "m.origin")


def budget_slots(slots: DataFrame) -> DataFrame:
    """Ledger slots (key, gen, node, granted, returned): the greatest of each amount."""
    return slots.groupBy("key", "gen", "node").agg(F.max("granted").alias("granted"), F.max("returned").alias("returned"))


def budget_tokens(tokens: DataFrame) -> DataFrame:
    """Budget tokens: a higher rank (open < expired < folded) absorbs a lower whenever it came."""
    rest = [c for c in tokens.columns if c not in ("key", "token")]
    payload = [c for c in _orderable(tokens, rest) if c not in ("rank", *VERSION)]
    return tokens.groupBy("key", "token").agg(F.max_by(F.struct(*rest), F.struct("rank", *VERSION, *payload)).alias("r")).select("key", "token", "r.*")


def one_of(fields: DataFrame) -> DataFrame:
    """(key, oneof, field): which member of each oneof is set, the one with the greatest live dot."""
    return fields.groupBy("key", "oneof").agg(F.max_by("field", version("field")).alias("field"))


def rga(nodes: DataFrame) -> DataFrame:
    """(key, nth, value) of replicated arrays (key, hlc, origin, left_hlc, left_origin, value, tomb).

    Elements stand after the element they were inserted after, the newest first; dead elements still
    anchor others; elements whose anchor is unknown start the array. An array is one group: it is a
    document's field and is read whole by its nature.
    """

    def order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["hlc", "origin", "left_hlc", "left_origin", "tomb", "value"], ascending=False)
        rows = group.drop_duplicates(["hlc", "origin"]).to_dict("records")
        known = {(r["hlc"], r["origin"]) for r in rows}
        after: dict = {}
        for r in sorted(rows, key=lambda r: (r["hlc"], r["origin"])):
            anchor = (r["left_hlc"], r["left_origin"])
            after.setdefault(anchor if anchor in known and anchor != (r["hlc"], r["origin"]) else None, []).append(r)
        out, stack, seen = [], list(after.get(None, [])), set()
        while stack:
            r = stack.pop()
            at = (r["hlc"], r["origin"])
            if at in seen:
                continue
            seen.add(at)
            if not r["tomb"]:
                out.append((r["key"], len(out), r["value"]))
            stack.extend(after.get(at, []))
        return pd.DataFrame(out, columns=["key", "nth", "value"])

    return nodes.groupBy("key").applyInPandas(order, "key string, nth long, value string")
