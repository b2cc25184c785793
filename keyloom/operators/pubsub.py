"""Publish and subscribe as joins: messages (seq, channel, message) with subscriptions (conn, channel) and (conn, pattern).
The same functions serve batch tables and streams (stream-static joins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import glob


def fanout(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """A row per receiver of each message, by channel."""
    return messages.join(subs, "channel").select("seq", "conn", "channel", "message")


def pattern_fanout(messages: DataFrame, patterns: list[tuple[object, str]]) -> DataFrame:
    """A row per receiver by pattern; the patterns are a driver-side list, tested in one pass over the messages."""
    if not patterns:
        return messages.select("seq", F.lit(None).cast("string").alias("conn"), "channel", "message").limit(0)
    hits = F.array(*[F.when(glob(F.col("channel"), p), F.struct(F.lit(str(c)).alias("conn"), F.lit(p).alias("pattern"))) for c, p in patterns])
    return messages.withColumn("hit", F.explode(F.array_compact(hits))).select("seq", "hit.conn", "hit.pattern", "channel", "message")


def publish_replies(messages: DataFrame, subs: DataFrame, patterns: list[tuple[object, str]]) -> DataFrame:
    """(seq, receivers): deliveries by channel and by pattern; a connection that matches both ways counts twice."""
    direct = messages.join(subs, "channel", "left").groupBy("seq", "channel").agg(F.count("conn").alias("n"))
    by_glob = reduce(lambda a, b: a + b, [glob(F.col("channel"), p).cast("int") for _, p in patterns], F.lit(0))
    return direct.select("seq", (F.col("n") + by_glob).cast("long").alias("receivers"))


def channels(subs: DataFrame, pattern: str = "*") -> DataFrame:
    return subs.filter(glob(F.col("channel"), pattern)).select("channel").distinct()


def numsub(subs: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(subs.groupBy("channel").agg(F.count("*").alias("subscribers")), "channel", "left").fillna(0, ["subscribers"])


def numpat(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.count_distinct("pattern").alias("patterns"))


def subscribe(subs: DataFrame, conn: object, *names: str) -> DataFrame:
    new = subs.sparkSession.range(1).select(F.lit(conn).alias("conn"), F.explode(F.array(*map(F.lit, names))).alias("channel"))
    return subs.unionByName(new).dropDuplicates(["conn", "channel"])


def punsubscribe(patterns: DataFrame, conn: object, *names: str) -> DataFrame:
    """patterns (conn, pattern) without a connection's named patterns, or all of its patterns."""
    hit = F.col("conn") == F.lit(conn)
    return patterns.filter(~(hit & F.col("pattern").isin(list(names)) if names else hit))


def unsubscribe(subs: DataFrame, conn: object, *names: str) -> DataFrame:
    hit = F.col("conn") == F.lit(conn)
    return subs.filter(~(hit & F.col("channel").isin(list(names)) if names else hit))
