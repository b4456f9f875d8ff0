"""Near duplicates by SetSketch registers.

Each text is a set of word shingles. A SetSketch register holds the least of the exponential values
that its hash gives the set's elements, on a logarithmic scale and cut to 16 bits, so registers of
unions merge by maximum and equal registers tell of similar sets. Bands of registers put
candidates into buckets; a pair's similarity is estimated by maximum likelihood from how many
registers are larger, equal and smaller; pairs that may reach the threshold are confirmed on their
full shingle sets, and confirmed pairs are joined to components.

Scale. Texts of the same set are one class, found by digest with a map-side minimum, so copies never
meet. Buckets with the same members count once. They are gone through in two waves: the first
``early`` bands join most of what is similar, and of the others only the buckets whose members are not yet
joined are formed, and in them only pairs that are not are looked at; so a class and its text move a few times, not
once a band. Large buckets whose largest component is the same become one where that means fewer pairs, so
who stays outside a large group meets each member once. Buckets of up to ``block`` classes and ``max_bytes`` of text are compared in one task. Larger
ones are dealt into blocks: first every block meets a few leaders of its bucket, which takes time in
proportion to the bucket and joins most of it; then only members outside the bucket's largest component
meet the rest, block by block, and pairs within one component are skipped. No pair of a bucket is left
out, no bucket is collected whole, and what leaves a task is at most one link a row.

A pair at the threshold shares a band with a chance of all but 1e-7 or less (``bands``).

Defined results: null and empty texts have no shingles and are linked with nothing; texts with fewer
words than a shingle are one shingle; texts are read whole at any length; rows with shingles that share a
doc_id are one node of the graph, whatever their texts; of a component the least doc_id names it and is kept, on all rows
that have it; a row without doc_id has the component of its text's class, null where no row of that class has
one, and is kept; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, returning, scope
from .hashing import joined, mixed, shingles

RATE, BASE, TOP = 20.0, 1.001, 65534  # of the exponential values; spacing of registers; their largest value


@dataclass(frozen=True)
class Settings:
    width: int = 5
    percent: int = 80
    block: int = 256
    max_bytes: int = 32 << 20
    leaders: int = 4
    early: int = 4
    broadcast_ids: int = 2_000_000

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 84 else 5 if self.percent >= 78 else 4 if self.percent >= 70 else 3

    @property
    def bands(self) -> int:
        """Enough that a pair at the threshold is missed with a chance of 1e-7 at most."""
        return int(np.ceil(np.log(1e-7) / np.log1p(-((self.percent / 100) ** self.rows))))

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return x[:n], x[n:] | np.uint64(1)


def sketch(elements: np.ndarray, n: int) -> np.ndarray:
    """The registers of a set of hashes."""
    flip, times = _seeds(n)
    least = np.full(n, np.uint64(2**64 - 1))
    for i in range(0, len(elements), 1024):
        least = np.minimum(least, ((elements[i : i + 1024, None] ^ flip) * times).min(axis=0))
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = np.maximum(-np.log1p(-np.minimum(uniform, 1 - 1e-16)), 1e-300) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def likeliest(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, steps: int = 16) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from register comparisons and both set sizes."""
    u = n / (n + m)
    v = 1.0 - u
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        return larger * np.log(p) + smaller * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1.0))

    low, high = np.zeros(np.shape(u)), np.minimum(u / v, v / u)
    for _ in range(steps):  # the likelihood has one peak
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = fit(a) > fit(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _sketches(settings: Settings):
    width, n, rows = settings.width, settings.registers, settings.rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1000):
                sizes, lengths, high, low, registers, bands = [], [], [], [], [], []
                for text in texts.slice(at, 1000).to_pylist():
                    s = shingles(text, width)
                    sizes.append(len(s))
                    lengths.append(len(text or ""))
                    if not len(s):
                        high.append(None), low.append(None), registers.append(None), bands.append(None)
                        continue
                    order = np.arange(1, len(s) + 1, dtype=np.uint64)
                    high.append(int(mixed(s * np.uint64(3)).sum().astype(np.int64)))
                    low.append(int((mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * order).sum().astype(np.int64)))
                    r = sketch(s, n)
                    registers.append(r.tobytes())
                    cols = r.astype(np.uint64).reshape(-1, rows)
                    bands.append(joined(np.arange(len(cols), dtype=np.uint64), *cols.T).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 1000), batch.column(2).slice(at, 1000), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "n", "bytes", "high", "low", "registers", "bands"],
                )

    return lambda batches: returning(of, batches)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[b] = a
        return a != b


def _links(group: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Links that join what is similar in a group of bounded size.

    Rows with ``lead`` meet all rows; rows of one ``label`` count as joined already.
    """
    group = group.drop_duplicates("cid").sort_values("cid").reset_index(drop=True)
    k, n = len(group), group["n"].to_numpy(np.float64)
    regs = np.frombuffer(b"".join(group["registers"]), dtype=np.uint16).reshape(k, -1).astype(np.int32)
    lead = np.flatnonzero(group["lead"].to_numpy())
    forest, first = _Forest(k), {}
    for i, label in enumerate(group["label"]):
        if label in first:
            forest.join(first[label], i)
        first.setdefault(label, i)
    total = regs.shape[1]
    floor = settings.percent / 100 - 6 * np.sqrt(0.25 / total)
    is_lead = group["lead"].to_numpy()
    label = group["label"].to_numpy()
    a, b, larger, equal = [], [], [], []
    for i in lead:
        other = np.flatnonzero(((np.arange(k) > i) | ~is_lead) & (label != label[i]))
        other = other[100 * np.minimum(n[other], n[i]) >= settings.percent * np.maximum(n[other], n[i])]
        theirs = regs[other]
        a.append(np.full(len(other), i)), b.append(other)
        larger.append((regs[i] > theirs).sum(1)), equal.append((regs[i] == theirs).sum(1))
    out = []
    if a:
        a, b, larger, equal = (np.concatenate(x) for x in (a, b, larger, equal))
        guess = likeliest(larger, total - larger - equal, equal, n[a], n[b])
        near = guess >= floor
        a, b, guess = a[near], b[near], guess[near]
        sets: dict[int, np.ndarray] = {}
        texts = group["text"]
        for at in np.argsort(-guess, kind="stable"):
            x, y = int(a[at]), int(b[at])
            if forest.top(x) == forest.top(y):
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = shingles(texts[z], settings.width)
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= settings.percent * (len(sets[x]) + len(sets[y]) - common):
                forest.join(x, y)
                out.append((group["cid"][x], group["cid"][y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _compare(rows: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """(a, b) confirmed links within each group of ``rows`` (cid, n, registers, text, lead, label)."""
    held = rows.select(*keys, "cid", "n", "registers", "text", "lead", "label")
    return held.groupBy(*keys).applyInPandas(lambda group: _links(group, settings), "a long, b long")


def _buckets(classes: DataFrame, first: int, last: int, met: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The buckets (size, of, of2, key, bytes) that bands ``first`` to ``last`` make of ``classes`` (cid, bytes, label, bands), and their members.

    Only those with several labels; of those with the same members one, and none that is in ``met``.
    """
    spread = classes.select("cid", "label", F.col("bytes").alias("own"), F.explode(F.slice("bands", first + 1, last - first)).alias("key"))
    same, signs = F.xxhash64("cid"), ["size", "of", "of2"]
    sums = [F.count("*").alias("size"), F.bit_xor(same).alias("of"), F.sum(same.bitwiseAND(F.lit((1 << 40) - 1))).alias("of2"), F.sum("own").alias("bytes")]
    found = spread.groupBy("key").agg(*sums, F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    found = found.groupBy(*signs).agg(F.min("key").alias("key"), F.max("bytes").alias("bytes"))
    found = cut(found if met is None else found.join(met.select(*signs), signs, "left_anti"))
    return found, cut(spread.join(found.select("key", "size", "bytes"), "key"))


def _facts(reps: DataFrame, texts: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """(cid, n, registers, text) of the classes ``ids`` (cid), which are broadcast only while they are few."""
    side = F.broadcast if ids.count() <= settings.broadcast_ids else (lambda x: x)
    wanted = texts.join(side(ids.withColumnRenamed("cid", "mark")), "mark", "left_semi").select(F.col("mark").alias("cid"), "text")
    return cut(reps.join(side(ids), "cid", "left_semi").select("cid", "n", "registers").join(wanted, "cid").dropDuplicates(["cid"]))


def _united(rows: DataFrame) -> DataFrame:
    """The members (key, cid, own, label) of buckets with several labels, with size and bytes of the bucket and its largest label: main, and out and out_bytes beside it.

    Buckets of one main label become one where that means fewer pairs to look at: who is outside then meets a member once, not once a bucket.
    """

    def tally(of: DataFrame) -> DataFrame:
        by = of.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("own").alias("b"))
        by = by.groupBy("key").agg(F.max(F.struct("c", "label", "b")).alias("m"), F.sum("c").alias("size"), F.sum("b").alias("bytes")).where(F.col("m.c") < F.col("size"))
        return by.select("key", F.col("m.label").alias("main"), "size", "bytes", (F.col("size") - F.col("m.c")).alias("out"), (F.col("bytes") - F.col("m.b")).alias("out_bytes"))

    member = ["key", "cid", "own", "label"]
    named = cut(rows.select(*member).join(tally(rows), "key"))
    apart = named.groupBy("main").agg(F.countDistinct("key").alias("buckets"), F.sum((F.col("label") != F.col("main")).cast("long") * F.col("size")).alias("pairs"))
    once = cut(named.groupBy("main", "cid").agg(F.min("own").alias("own"), F.min("label").alias("label")))
    whole = once.groupBy("main").agg((F.count("*") * F.sum((F.col("label") != F.col("main")).cast("long"))).alias("fewer"))
    pays = cut(whole.join(apart, "main").where("buckets > 1 AND fewer <= pairs").select("main"))
    if pays.isEmpty():
        return named
    together = once.join(pays, "main", "left_semi").select(F.col("main").alias("key"), "cid", "own", "label")
    all_ = cut(named.join(pays, "main", "left_anti").select(*member).unionByName(together))
    return cut(all_.join(tally(all_), "key"))


def _wave(inside: DataFrame, facts: DataFrame, known: list[DataFrame], settings: Settings) -> list[DataFrame]:
    """Links between the members (key, cid, own, label, size, bytes) of each bucket; rows of one label are joined already, by ``known`` links."""
    fits = (F.col("size") <= settings.block) & (F.col("bytes") <= settings.max_bytes)
    blocks = lambda size, of: F.greatest(F.ceil(2 * F.col(size) / settings.block), F.ceil(2 * F.col(of) / settings.max_bytes), F.lit(1)).cast("int")
    parts = blocks("size", "bytes")
    dealt = lambda rows: rows.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "cid"), parts).cast("int"))
    links = [cut(_compare(inside.where(fits).withColumn("lead", F.lit(True)).join(facts, "cid"), ["key"], settings))]
    if inside.where(~fits).isEmpty():
        return links
    large = dealt(_united(inside.where(~fits)))
    # Leaders: the classes of least seeded hash in each bucket, one of each of a few draws.
    draws = F.array(*[F.struct(F.xxhash64(F.lit(s), "key", "cid").alias("h"), F.col("cid"), F.col("label")) for s in range(settings.leaders)])
    drawn = large.select("key", "size", "bytes", F.posexplode(draws)).groupBy("key", "size", "bytes", "pos").agg(F.min("col").alias("l"))
    leaders = drawn.select("key", "size", "bytes", F.col("l.cid").alias("cid"), F.col("l.label").alias("label")).distinct()
    everywhere = leaders.select("key", "cid", "label", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("lead"))
    first = large.select("key", "cid", "label", "part", F.lit(False).alias("lead")).unionByName(everywhere)
    first = first.groupBy("key", "part", "cid", "label").agg(F.max("lead").alias("lead"))
    links.append(cut(_compare(first.join(facts, "cid"), ["key", "part"], settings)))
    # The rest, exactly: who is outside the largest component of a bucket meets the others.
    labels = components(reduce(DataFrame.unionByName, [*known, *links]))
    named = cut(large.select("key", "cid", "own").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    open_ = dealt(_united(named))
    if open_.isEmpty():
        return links
    outer = blocks("out", "out_bytes")
    ahead = open_.where("label <> main").withColumn("i", F.pmod(F.xxhash64(F.lit(4), "cid"), outer).cast("int"))
    lead_rows = ahead.select("cid", "key", "label", "i", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("lead"))
    other = open_.select("cid", "key", "label", F.explode(F.sequence(F.lit(0), outer - 1)).alias("i"), "part", F.lit(False).alias("lead"))
    met = lead_rows.unionByName(other).groupBy("key", "i", "part", "cid", "label").agg(F.max("lead").alias("lead"))
    return [*links, cut(_compare(met.join(facts, "cid"), ["key", "i", "part"], settings))]


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each can reach, of links between ``a`` and ``b``."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    links = [b[["a", "b"]].to_numpy() for b in batches]
    ends = np.concatenate([np.zeros((0, 2), np.int64), *links])
    nodes, labels = settled(ends[:, 0], ends[:, 1])
    yield pd.DataFrame({"node": nodes, "label": labels})[nodes != labels]


def components(links: DataFrame, rounds: int = 60, few: int = 1_000_000) -> DataFrame:
    """(node, label): the least node that each linked node (long) can reach.

    Up to ``few`` links, 16 MB of them, are settled by one task. More of them go through rounds of two
    alternating star steps, each a minimum by node and a join; edges never grow in number.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long"))).first())
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    if seen[0] <= few:
        return edges.coalesce(1).mapInPandas(_settled, "node long, label long")
    for _ in range(rounds):
        if not seen[0]:
            break
        sides = both(edges)
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("doc_id", "text"))  # a doc_id alone may stand for several texts
    made = cut(texts.mapInArrow(_sketches(settings), "doc_id long, mark long, n long, bytes long, high long, low long, registers binary, bands array<long>"))
    full = made.where(F.col("high").isNotNull() & F.col("doc_id").isNotNull())
    member = ["high", "low"]
    # A class goes by the mark of its first row.
    classes = full.groupBy(*member).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    classes = cut(classes.select(*member, F.col("first.mark").alias("cid"), F.col("first.doc_id").alias("least")))
    reps = classes.join(full, member).where(F.col("mark") == F.col("cid")).select("cid", "n", "bytes", "registers", "bands").dropDuplicates(["cid"])
    reps = cut(reps)

    # Two waves of buckets: classes that share a band. The second looks at what the first has not joined.
    links, known, met, classed = [], [], None, reps.withColumn("label", F.col("cid"))
    for low, high in ((0, min(settings.early, settings.bands)), (settings.early, settings.bands)):
        if low >= high:
            continue
        if links:
            labels = cut(components(reduce(DataFrame.unionByName, links)))
            classed = reps.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
            known = [labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))]
        met, inside = _buckets(classed, low, high, met)
        with scope() as passing:
            facts = _facts(reps, texts, cut(inside.select("cid").distinct()), settings)
        links = [*known, *_wave(inside, facts, known, settings)]
        drop(docs.sparkSession, passing)
    # Classes that share a doc_id are one node.
    of = F.xxhash64(*member)
    again = cut(full.groupBy("doc_id").agg(F.min(of).alias("x"), F.max(of).alias("y")).where("x <> y").select("doc_id"))
    if not again.isEmpty():
        named = cut(full.join(again, "doc_id").join(classes, member).select("doc_id", "cid").distinct())
        links.append(cut(named.join(named.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b"))))
    labels = cut(components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "cid"))
    labels = labels.unionByName(labels.select(F.col("label").alias("cid"), "label").distinct())  # the least nodes too
    named = cut(classes.join(labels, "cid", "left").select(*member, "label", "least"))
    tops = named.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("top"))
    named = named.join(tops, "label", "left").select(*member, F.coalesce("top", "least").alias("component_id"))
    out = made.select("doc_id", "n", *member).join(named, member, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
