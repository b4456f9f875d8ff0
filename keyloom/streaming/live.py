"""Streams of records: continuous merge, cursor reads, budget windows, subscriptions and blocking pops.

State is keyed, so it is spread like the keys are; timers bound what must not be kept for ever.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.functions.patterns import glob_match
from keyloom.operators.merge import lww


def _order(version: tuple) -> tuple:
    """Of records of one version the greatest value wins, as in batch."""
    hlc, origin, value = version
    return hlc, origin, value is not None, value or ""


def merge_stream(records: DataFrame) -> DataFrame:
    """(key, elem, value, hlc, origin) whenever the winner of an element changes.

    Records (key, elem, value, hlc, origin) may come late and twice: the state of an element is its greatest
    version, so order does not matter and no watermark drops anything.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        was = best
        for b in batches:
            for value, hlc, origin in zip(b["value"], b["hlc"], b["origin"], strict=True):
                at = (int(hlc), int(origin), value)
                if best is None or _order(at) > _order(best):
                    best = at
        if best is not None and best != was:
            state.update(best)
            yield pd.DataFrame([(*key, best[2], best[0], best[1])], columns=["key", "elem", "value", "hlc", "origin"])

    return records.groupBy("key", "elem").applyInPandasWithState(
        step, "key string, elem string, value string, hlc long, origin int", "hlc long, origin int, value string", "update", GroupStateTimeout.NoTimeout
    )


def merge_into_table(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch, merged, to a record log; a batch that is retried replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        lww(batch, ["key", "elem"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return lww(spark.read.parquet(path).drop("batch"), ["key", "elem"])


def budget_windows(requests: DataFrame, period: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(win, key, asked): amounts of requests (ts, key, amount) by tumbling window, once it can't change."""
    return (
        requests.withWatermark("ts", lateness).groupBy(F.window("ts", period).alias("w"), "key")
        .agg(F.sum("amount").alias("asked")).select(F.col("w.start").alias("win"), "key", "asked")
    )


def subscribe(messages: DataFrame, *channels: str) -> DataFrame:
    return messages.where(F.col("channel").isin(*channels))


def psubscribe(messages: DataFrame, pattern: str) -> DataFrame:
    return messages.where(glob_match(F.col("channel"), pattern))


def xread_stream(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Entries that arrive in a stream's folder; the query's checkpoint is the reader's cursor."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("key").isin(*keys))


def blocking_pop(commands: DataFrame, left: bool = True) -> DataFrame:
    """(key, seq, value): BLPOP and BRPOP over a stream of commands (key, seq, op, value).

    ``push`` adds to its key's list; a ``pop`` takes an element, or waits in state until one is pushed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, waiting = map(deque, state.get) if state.exists else (deque(), deque())
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, op, value in zip(rows["seq"], rows["op"], rows["value"], strict=True):
            if op == "push":
                items.append(value)
            else:
                waiting.append(int(seq))
            while items and waiting:
                out.append((key[0], waiting.popleft(), items.popleft() if left else items.pop()))
        state.update((list(items), list(waiting)))
        yield pd.DataFrame(out, columns=["key", "seq", "value"])

    return commands.groupBy("key").applyInPandasWithState(
        step, "key string, seq long, value string", "items array<string>, waiting array<long>", "append", GroupStateTimeout.NoTimeout
    )


def blocking_move(commands: DataFrame, from_left: bool = False) -> DataFrame:
    """(dst, seq, value): BLMOVE and BRPOPLPUSH over commands (key, seq, op, value, dst).

    A ``move`` takes an element of its key for ``dst``, or waits; the rows that come out are the pushes
    onto the targets.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, waiting, targets = map(deque, state.get) if state.exists else (deque(), deque(), deque())
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, op, value, dst in zip(rows["seq"], rows["op"], rows["value"], rows["dst"], strict=True):
            if op == "push":
                items.append(value)
            else:
                waiting.append(int(seq))
                targets.append(dst)
            while items and waiting:
                out.append((targets.popleft(), waiting.popleft(), items.popleft() if from_left else items.pop()))
        state.update((list(items), list(waiting), list(targets)))
        yield pd.DataFrame(out, columns=["dst", "seq", "value"])

    return commands.groupBy("key").applyInPandasWithState(
        step, "dst string, seq long, value string", "items array<string>, waiting array<long>, targets array<string>", "append", GroupStateTimeout.NoTimeout
    )


class _Last(str):
    """A member that sorts from the last to the first."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


def blocking_zpop(commands: DataFrame, most: bool = False) -> DataFrame:
    """(key, seq, member, score): BZPOPMIN and BZPOPMAX over commands (key, seq, op, member, score).

    Of equal scores BZPOPMIN takes the least member, BZPOPMAX the greatest. Members are held in a heap, in which a
    member that was added again stays under its older scores until these come up.
    """
    entry = (lambda score, member: (-score, _Last(member))) if most else (lambda score, member: (score, member))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        members, scores, waiting = state.get if state.exists else ([], [], [])
        held, waiting = dict(zip(members, scores, strict=True)), deque(waiting)
        heap = [entry(score, member) for member, score in held.items()]
        heapq.heapify(heap)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, op, member, score in zip(rows["seq"], rows["op"], rows["member"], rows["score"], strict=True):
            if op == "add":
                held[member] = float(score)
                heapq.heappush(heap, entry(held[member], member))
            else:
                waiting.append(int(seq))
            while heap and waiting:
                order, chosen = heapq.heappop(heap)
                chosen = str(chosen)
                if held.get(chosen) == (-order if most else order):
                    out.append((key[0], waiting.popleft(), chosen, held.pop(chosen)))
        state.update((list(held), list(held.values()), list(waiting)))
        yield pd.DataFrame(out, columns=["key", "seq", "member", "score"])

    return commands.groupBy("key").applyInPandasWithState(
        step, "key string, seq long, member string, score double", "members array<string>, scores array<double>, waiting array<long>", "append", GroupStateTimeout.NoTimeout
    )


def expire_stream(records: DataFrame) -> DataFrame:
    """(key, elem, hlc): a tombstone for each element whose deadline (event time ``ttl``) the watermark passes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (deadline,) = state.get
            state.remove()
            yield pd.DataFrame([(*key, deadline << 16)], columns=["key", "elem", "hlc"])
            return
        latest = state.get[0] if state.exists else 0
        for b in batches:
            latest = max(latest, int(b["ttl_ms"].max()))
        state.update((latest,))
        if latest > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(latest)
        else:
            state.remove()
            yield pd.DataFrame([(*key, latest << 16)], columns=["key", "elem", "hlc"])

    return records.withWatermark("ts", "0 seconds").groupBy("key", "elem").applyInPandasWithState(
        step, "key string, elem string, hlc long", "deadline long", "append", GroupStateTimeout.EventTimeTimeout
    )


def settled(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream has given once all that is there now was read, as a table below ``folder``."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/at")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
