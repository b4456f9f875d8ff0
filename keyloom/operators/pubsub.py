"""Channels, subscriptions and prefix bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.patterns import glob_match


def receivers(messages: DataFrame, channels: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(seq, channel, receivers) of messages (seq, channel): subscriptions (subscriber, channel) by equality,
    and (subscriber, pattern) globs.

    Patterns are given by the caller and compile into one expression over the distinct channels, so
    messages are never paired with patterns.
    """
    subscribed = channels.groupBy("channel").agg(F.count("*").alias("__c"))
    hits = F.lit(0)
    for _, p in patterns:
        hits = hits + glob_match(F.col("channel"), p).cast("int")
    return messages.join(subscribed, "channel", "left").select("seq", "channel", (F.coalesce("__c", F.lit(0)) + hits).cast("bigint").alias("receivers"))


def deliveries(messages: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(seq, channel, subscriber, pattern) of each pattern that a message's channel fits."""
    found = F.array_compact(F.array(*[F.when(glob_match(F.col("channel"), p), F.struct(F.lit(s).alias("subscriber"), F.lit(p).alias("pattern"))) for s, p in patterns]))
    return messages.select("seq", "channel", F.inline(found))


def channels(subscriptions: DataFrame, pattern: str = "*") -> DataFrame:
    """PUBSUB CHANNELS and NUMSUB: (channel, n)."""
    return subscriptions.where(glob_match(F.col("channel"), pattern)).groupBy("channel").agg(F.count("*").alias("n"))


def bind_longest_prefix(keys: DataFrame, bindings: DataFrame) -> DataFrame:
    """(key, prefix, type): the binding (prefix, type) of the longest prefix of each key.

    Keys meet bindings by equality on their prefixes of the lengths that bindings have, of which there
    are few, rather than by comparing every key with every binding.
    """
    lengths = bindings.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("l")).first()["l"] or []
    tries = F.array(*[F.substring("key", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
    own = keys.select("key").distinct()
    met = own.select("key", F.explode(F.array_distinct(tries)).alias("prefix")).where(F.col("key").startswith(F.col("prefix"))).join(bindings.select("prefix", "type"), "prefix")
    best = met.groupBy("key").agg(F.max_by(F.struct("prefix", "type"), F.length("prefix")).alias("b"))
    return own.join(best, "key", "left").select("key", "b.prefix", "b.type")
