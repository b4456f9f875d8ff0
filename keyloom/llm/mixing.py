"""Mixing overlapping sources to target weights by min-cost flow.

Documents are counted by membership pattern (the set of sources they belong to). Each pattern
offers its words once at no cost and every further copy at a growing cost; each source asks for
its target. The cheapest flow from patterns to sources says how many words of each pattern the
mix takes, and seeded documents of the pattern make that number up: all of them ``base`` times,
and some once more, in the order of a seeded hash.

The seeded order needs no sort of a whole pattern: words are summed by pattern and hash bucket
(``BUCKETS`` of them), which finds the bucket where the quota runs out; only that bucket is sorted, with
rows of one place in the order as one. One more document, the one of the size nearest to the words
still missing, closes the gap.
The flow runs on the driver over patterns and sources, of which at most ``max_patterns`` may exist; more
are an error.

Defined results: null and empty texts have size 0 and are taken 0 words; a null source is a source
of its own; null ``sources`` are none, and none of their words are taken; repeated rows are separate
documents, which tie in the seeded order, and as many of them are taken as fit; texts count by their
size only, at any length; an empty table gives an empty mix. Other columns pass through, but for those
called ``taken`` and ``repeats``, which are replaced, and those that begin with ``__``, which go.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered

BUCKETS = 4096
WEIGHTS = (3, 1, 2)


def weighted_targets(sizes: Mapping[str | None, int], share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS) -> dict[str | None, float]:
    """Split ``share`` of all words by repeating weights; no source above ``most`` times its words.

    What a stopped source leaves goes to the others by weight, until none is above its stop.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        stopped = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not stopped:
            out.update((s, left * weight[s] / total) for s in open_)
            break
        for s in stopped:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in stopped)
        open_ = [s for s in open_ if s not in out]
    return out


def route(supply: Mapping[tuple, int], demand: Mapping[str | None, int], copies: int) -> dict[tuple, dict[str | None, int]]:
    """Cheapest flow of words: pattern -> source -> words.

    The k-th copy of a pattern costs k - 1 a word, so repetition is spread before it deepens.
    Successive shortest paths with potentials; capacities are whole words.
    """
    patterns, sources = sorted(supply, key=str), sorted(demand, key=str)
    node = {("p", p): i + 1 for i, p in enumerate(patterns)} | {("s", s): len(patterns) + 1 + i for i, s in enumerate(sources)}
    sink = len(node) + 1
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        cost.extend((price, -price))
        return len(to) - 2

    links = {}
    for p in patterns:
        for k in range(copies):
            arc(0, node["p", p], supply[p], k)
        for s in p:
            if s in demand:
                links[p, s] = arc(node["p", p], node["s", s], copies * supply[p], 0)
    for s in sources:
        arc(node["s", s], sink, demand[s], 0)
    height = [0] * (sink + 1)
    while True:
        far, via = [float("inf")] * (sink + 1), [-1] * (sink + 1)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in head[a]:
                if room[e] > 0 and (new := d + cost[e] + height[a] - height[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = new, e
                    heapq.heappush(queue, (new, to[e]))
        if far[sink] == float("inf"):
            break
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far, strict=True)]
        path, at = [], sink
        while at:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    out: dict[tuple, dict[str | None, int]] = {p: {} for p in patterns}
    for (p, s), e in links.items():
        if room[e ^ 1]:
            out[p][s] = room[e ^ 1]
    return out


def sizes_by_source(rows: DataFrame, sources: str = "sources") -> dict[str | None, int]:
    """Words of each source; one row a source comes to the driver."""
    got = rows.select(F.explode(sources).alias("s"), "size").groupBy("s").agg(F.sum("size").alias("n")).collect()
    return {r["s"]: int(r["n"]) for r in got}


def _pattern() -> Column:
    return F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with their pattern as a text, their place in the seeded order, and its bucket."""
    # A text of the pattern that tells null from any string, as join and group key.
    name = F.concat_ws(",", F.transform(_pattern(), lambda s: F.coalesce(F.concat(F.lit("="), F.length(s).cast("string"), F.lit(":"), s), F.lit("~"))))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), "size")
    bucket = F.shiftrightunsigned(order, 64 - BUCKETS.bit_length() + 1).cast("int")
    return rows.drop(*[c for c in rows.columns if c.startswith("__")]).withColumns({"__pattern": name, "__order": order, "__bucket": bucket})


@dataclass
class _Plan:
    """What the mix takes of a pattern: all documents ``base`` times, and once more those before a place in
    the order, ``copies`` of the next place, and one of the place ``also``."""

    base: int
    rest: int
    edge: int = BUCKETS
    before: int = 0
    upto: int | None = None
    place: int | None = None
    copies: int = 0
    left: int = 0
    also: int | None = None


def _with_plan(rows: DataFrame, plan: Mapping[str, _Plan]) -> DataFrame:
    """Rows with their pattern's plan; ``__more`` where it is sure that a row is taken once more."""
    fields = "__base long, __rest long, __edge int, __before long, __upto long, __place long, __copies long, __left long, __also long"
    table = rows.sparkSession.createDataFrame([(p, *astuple(x)) for p, x in plan.items()], "__pattern string, " + fields)
    step = rows.join(F.broadcast(table), "__pattern")  # one row a pattern
    edge = (F.col("__bucket") == F.col("__edge")) & F.coalesce(F.col("__order") <= F.col("__upto"), F.lit(False))
    return step.withColumn("__more", (F.col("__bucket") < F.col("__edge")) | edge)


def mix(rows: DataFrame, targets: Mapping[str | None, float], copies: int = 2, seed: int = 0, max_patterns: int = 20_000, narrow: DataFrame | None = None) -> DataFrame:
    """``rows`` (``doc_id``, ``size`` long, ``sources`` array<string>) with ``taken`` and ``repeats``.

    Documents of the pattern enter in seeded order while they fit its quota; then one more, whose size is
    nearest to what is still missing: of rows that tie, one. ``narrow`` may hold the same rows with these three columns only; the
    plan is then made from it, and wide rows are read once.
    """
    small = _keyed(rows if narrow is None else narrow, seed)
    found = small.select("__pattern", _pattern().alias("sources"), "size").groupBy("__pattern").agg(F.sum("size").alias("n"), F.first("sources").alias("sources"))
    # At most max_patterns rows, checked here; so are the tables collected below.
    found = found.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    supply = {tuple(r["sources"]): int(r["n"]) for r in found}
    flow = route(supply, {s: int(round(t)) for s, t in targets.items()}, copies)
    plan = {}
    for r in found:
        p = tuple(r["sources"])
        plan[r["__pattern"]] = _Plan(*divmod(sum(flow[p].values()), supply[p])) if supply[p] else _Plan(0, 0)
    # The bucket where the words of each pattern run out.
    upto = F.sum("__words").over(W.partitionBy("__pattern").orderBy("__bucket"))
    filled = _with_plan(small.groupBy("__pattern", "__bucket").agg(F.sum("size").alias("__words")).withColumns({"__upto_words": upto, "__order": F.lit(0)}), plan)
    edge = filled.where(F.col("__upto_words") >= F.col("__rest")).groupBy("__pattern").agg(F.min(F.struct("__bucket", (F.col("__upto_words") - F.col("__words")).alias("before"))).alias("e"))
    for r in edge.collect():
        plan[r["__pattern"]].edge, plan[r["__pattern"]].before = r["e"]["__bucket"], int(r["e"]["before"])
    # The place within it, rows of one place as one.
    places = _with_plan(small, plan).where(F.col("__bucket") == F.col("__edge")).groupBy("__pattern", "__order", "__before", "__rest").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    places = places.withColumn("upto", F.col("__before") + F.sum("w").over(W.partitionBy("__pattern").orderBy("__order")))
    fits = F.col("upto") <= F.col("__rest")
    whole = F.max(F.when(fits, F.struct("upto", "__order")))
    after = F.min(F.when(~fits, F.struct("__order", "n", "w")))
    for r in places.groupBy("__pattern").agg(whole.alias("whole"), after.alias("after")).collect():
        own = plan[r["__pattern"]]
        own.left = own.rest - own.before
        if r["whole"] is not None:
            own.upto, own.left = r["whole"]["__order"], own.rest - int(r["whole"]["upto"])
        if r["after"] is not None:
            size = max(1, int(r["after"]["w"]) // int(r["after"]["n"]))
            own.place, own.copies = r["after"]["__order"], own.left // size
            own.left -= own.copies * size
    # The document nearest in size to what is still missing.
    spare = _with_plan(small, plan).where(~F.col("__more") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("__left")))
    for r in spare.groupBy("__pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("__left")).alias("d"), "__order")).alias("m")).collect():
        plan[r["__pattern"]].also = r["m"]["__order"]
    step = _with_plan(_keyed(rows, seed), plan)
    tied = lambda place: F.coalesce(F.col("__order") == F.col(place), F.lit(False)) & ~F.col("__more")
    places = step.where(tied("__place") | tied("__also")).withColumn("__in", F.when(tied("__place"), F.col("__copies")).otherwise(F.lit(0)) + tied("__also").cast("long"))
    some = numbered(places, ["__pattern", "__order"], "__nth").withColumn("__more", F.col("__nth") < F.col("__in")).drop("__in", "__nth")
    out = step.where(~(tied("__place") | tied("__also"))).unionByName(some)
    out = out.withColumn("repeats", F.least(F.col("__base") + F.col("__more").cast("long"), F.lit(copies)).cast("long"))
    out = out.withColumn("taken", F.col("repeats") * F.col("size"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])
