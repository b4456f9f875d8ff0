"""Sharding by balanced label propagation: copies of a text move together, sizes stay even.

Documents with equal texts are linked, each to each, through their text's digest. Every document starts
with a hashed shard as its label. Then, round by round, linked documents look at their neighbours'
labels, which a join of texts with labels counts by bytes, and move towards the shard that holds most of
them, of those with room left, as far as that shard's quota goes. Who is turned away keeps its label and
looks again in the next round, when some of those shards are full; where none of them has room, a seeded
draw by free room decides. Documents without copies fill what is left. ``cut_edges`` counts the links
between shards.

Balance: let C be the mean bytes of a shard. A text with more than ``CHUNK`` of C is cut into
seeded parts, as no shard could hold it; rows that are the same in all are dealt over them in turn. Units
of more than C/``FINE`` bytes number at most ``FINE`` times the shards, so they are placed on the driver,
largest first, each in its best shard with room. All others are smaller than C/``FINE``. Documents without
copies are then laid end to end in a seeded order and cut where shards are full: bytes are summed by hash
bucket, and only the buckets where a cut falls are sorted. Shards end within about C/``FINE`` of each other.

Defined results: a null text counts as no bytes and is linked with nothing, not even with other rows of
its doc_id; equal texts may share a doc_id; repeated rows are separate documents; texts count by their bytes
and digest, at any length; of shards that tie the smaller wins; rows that are the same in all are
interchangeable; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, numbered

BUCKETS = 4096
FINE = 50
CHUNK = 0.8


def _bucket(*of: Column | str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")


def _rows(df: DataFrame) -> list:
    """Rows of a table whose size its comment bounds."""
    return df.collect()


def place(docs: DataFrame, shards: int = 40, rounds: int = 4, extra: int = 16, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard) of every document."""
    spark = docs.sparkSession
    body = F.col("text").cast("string").cast("binary")
    rows = cut(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + extra).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("digest")
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    # A text's parts: the documents of a text that no shard can hold are dealt over seeded parts.
    texts = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    texts = cut(texts.select("digest", F.greatest(F.ceil(F.col("bytes") / max(1.0, CHUNK * mean)), F.lit(1)).cast("int").alias("parts")))
    linked = rows.join(texts, "digest", "left")
    # Rows that are the same in all are told apart by a number where one hash would send all of them one way.
    alike = F.coalesce(F.col("parts") > 1, F.lit(False)) | F.col("digest").isNull()
    linked = linked.where(~alike).withColumn("nth", F.lit(0).cast("long")).unionByName(numbered(linked.where(alike), ["doc_id", "digest"], "nth"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit(seed), "doc_id") + F.col("nth"), F.col("parts"))).otherwise(F.lit(0))
    unit = F.when(F.col("parts").isNotNull(), F.concat(F.col("digest"), F.lit("/"), part.cast("string")))
    start = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest"), F.lit(shards)).cast("int")
    linked = cut(linked.select("doc_id", "size", "text_crc32", "digest", "nth", unit.alias("unit"), start.alias("start")))

    units = cut(linked.where(F.col("unit").isNotNull()).groupBy("unit", "start").agg(F.sum("size").alias("bytes")).withColumnRenamed("start", "shard"))
    whole = units.groupBy("unit").agg(F.sum("bytes").alias("bytes"))
    # At most FINE * shards units and documents are larger than mean / FINE.
    large_at = mean / FINE
    room = [mean] * shards
    placed: dict[str, int] = {}
    singles: dict[tuple, list[int]] = {}
    large = [(r["bytes"], 0, r["unit"]) for r in _rows(whole.where(F.col("bytes") > large_at))]
    lone = linked.where(F.col("unit").isNull() & (F.col("size") > large_at))
    large += [(r["size"], 1, (r["doc_id"], r["digest"])) for r in _rows(lone.select("doc_id", "digest", "size"))]
    for size, kind, what in sorted(large, key=lambda x: (-x[0], x[1], str(x[2]))):
        best = max(range(shards), key=lambda s: (room[s], -s))
        room[best] -= size
        if kind:
            singles.setdefault(what, []).append(best)
        else:
            placed[what] = best

    # Rounds of propagation over the small units.
    done = spark.createDataFrame([(u, s) for u, s in placed.items()], "unit string, shard int")
    open_ = units.join(whole.where(F.col("bytes") <= large_at).select("unit"), "unit", "left_semi")
    settled = [done]
    for turn in range(rounds):
        free = [max(0.0, r) for r in room]
        open_seats = F.broadcast(spark.createDataFrame([(s, f > 0) for s, f in enumerate(free)], "shard int, room boolean"))  # one row a shard
        # Neighbours' labels by bytes; where none of their shards has room, a seeded draw by free room.
        marks = [x / (sum(free) or 1.0) for x in accumulate(free)]
        dice = F.pmod(F.xxhash64(F.lit(seed + turn), "unit"), F.lit(1 << 30)) / float(1 << 30)
        pick = F.lit(shards - 1)
        for s in range(shards - 1, -1, -1):
            pick = F.when(dice < marks[s], F.lit(s)).otherwise(pick)
        seen = F.max(F.when(F.col("room"), F.struct("bytes", (-F.col("shard")).alias("s"))))
        want = open_.join(open_seats, "shard").groupBy("unit").agg(seen.alias("m"), F.sum("bytes").alias("all"))
        want = want.select("unit", F.coalesce(-F.col("m.s"), pick).cast("int").alias("shard"), "all")
        want = cut(want)
        asked = {r["shard"]: int(r["b"]) for r in _rows(want.groupBy("shard").agg(F.sum("all").alias("b")))}  # one row a shard
        if not asked:
            break
        quota = spark.createDataFrame([(s, min(1.0, max(0.0, room[s] * 0.98) / b) if b else 1.0) for s, b in asked.items()], "shard int, share double")
        dice = F.pmod(F.xxhash64(F.lit(seed + 100 + turn), "unit"), F.lit(1 << 30)) / float(1 << 30)
        chosen = want.join(F.broadcast(quota), "shard").withColumn("moves", dice < F.col("share"))
        chosen = cut(chosen)
        for r in _rows(chosen.where("moves").groupBy("shard").agg(F.sum("all").alias("b"))):  # one row a shard
            room[r["shard"]] -= int(r["b"])
        settled.append(chosen.where("moves").select("unit", "shard"))
        open_ = open_.join(chosen.where(~F.col("moves")).select("unit"), "unit", "left_semi")
    homes = settled[0]
    for more in settled[1:]:
        homes = homes.unionByName(more)

    named = cut(linked.join(homes, "unit", "left"))
    spots = [(d, g, i, s) for (d, g), list_ in singles.items() for i, s in enumerate(list_)]
    spot = spark.createDataFrame(spots, "doc_id long, digest string, nth int, spot int")
    is_large = F.col("shard").isNull() & (F.col("size") > large_at) & F.col("unit").isNull()
    nth = F.row_number().over(W.partitionBy("doc_id", "digest").orderBy("size")) - 1
    big = named.where(is_large).withColumn("nth", nth)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.digest").eqNullSafe(F.col("b.digest")) & (F.col("a.nth") == F.col("b.nth"))
    big = big.alias("a").join(F.broadcast(spot).alias("b"), same).select("a.doc_id", "a.size", "a.text_crc32", "a.digest", F.col("b.spot").alias("shard"))

    # The rest fills up: laid end to end, cut where shards are full.
    rest = named.where(F.col("shard").isNull() & ~is_large)
    item = F.coalesce("unit", F.concat_ws("#", F.lit(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("digest", F.lit("")), F.col("nth").cast("string")))
    rest = rest.withColumn("item", item).withColumn("bucket", _bucket(F.lit(seed), "item"))
    held = {r["bucket"]: int(r["b"]) for r in _rows(rest.groupBy("bucket").agg(F.sum("size").alias("b")))}  # at most BUCKETS rows
    wanted = [max(0.0, r) for r in room]
    scale = sum(held.values()) / (sum(wanted) or 1.0)
    ends = list(accumulate(w * scale for w in wanted))
    table, before, s = [], 0, 0
    for b in sorted(held):
        while s < shards - 1 and ends[s] <= before:
            s += 1
        whole_in = before + held[b] <= ends[s] or s == shards - 1
        table.append((b, s, whole_in, before))
        before += held[b]
    buckets = F.broadcast(spark.createDataFrame(table, "bucket int, first int, inside boolean, before long"))
    rest = rest.drop("shard").join(buckets, "bucket")
    inner = rest.where("inside").withColumn("shard", F.col("first"))
    line = W.partitionBy("bucket").orderBy("item").rangeBetween(W.unboundedPreceding, W.currentRow)
    whole_item = F.sum("size").over(W.partitionBy("bucket", "item"))
    middle = F.col("before") + F.sum("size").over(line) - whole_item / 2
    shard_at = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard_at = F.when(F.col("at") <= ends[s], F.lit(s)).otherwise(shard_at)
    outer = rest.where(~F.col("inside")).withColumn("at", middle).withColumn("shard", shard_at)
    columns = ("doc_id", "size", "text_crc32", "digest", "shard")
    out = named.where(F.col("shard").isNotNull()).select(*columns)
    for more in (big, inner, outer):
        out = out.unionByName(more.select(*columns))
    return out.withColumn("shard", F.col("shard").cast("int"))


def cut_edges(placed: DataFrame) -> int:
    """Links between documents of one text that lie in different shards."""
    tally = placed.where(F.col("digest").isNotNull()).groupBy("digest", "shard").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    sums = tally.groupBy("digest").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return int(sums.agg(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2)).first()[0] or 0)


def slots(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard; no shard is numbered by one task.

    A shard's rows are dealt into ``parts`` by hash, without which their number follows the rows'.
    """
    parts = max(64, -(-rows.count() // 4_000_000)) if parts is None else parts
    rows = cut(rows.withColumn("__part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int")))
    counts = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    base = counts.select("shard", "__part", (F.sum("__n").over(W.partitionBy("shard").orderBy("__part")) - F.col("__n")).alias("__base"))
    nth = F.row_number().over(W.partitionBy("shard", "__part").orderBy("doc_id", "digest", "size")) - 1
    out = rows.withColumn("__nth", nth).join(base, ["shard", "__part"]).withColumn("slot", (F.col("__nth") + F.col("__base")).cast("long"))
    return out.drop("__part", "__base", "__nth")
