"""Sets: tables (key, member[, expire_at_ms]) of distinct members. All keys are served at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import first_ranked, lit, live, upsert, without

KM = ["key", "member"]


def of(s: DataFrame, key: object) -> DataFrame:
    """Members of one key."""
    return s.filter(F.col("key") == lit(key)).select("member")


def sadd(s: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next version, (key, added) with the number of members that were new)."""
    fresh = new.select(*KM).distinct().join(s.select(*KM), KM, "left_anti")
    counts = new.select("key").distinct().join(fresh.groupBy("key").agg(F.count("*").alias("added")), "key", "left").fillna(0, ["added"])
    return s.unionByName(fresh, allowMissingColumns=True), counts


def saddex(s: DataFrame, new: DataFrame, ttl_seconds: int, now_ms: int, keep_ttl: bool = False) -> DataFrame:
    """Add members with an expiry of their own; a dead member counts as new, keep_ttl leaves living ones' expiry."""
    alive = live(s, now_ms)
    stamped = new.select(*KM).distinct().withColumn("expire_at_ms", F.lit(now_ms + 1000 * ttl_seconds).cast("long"))
    if keep_ttl:
        stamped = without(stamped, alive, KM)
    return upsert(alive, stamped, KM)


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return without(s, gone, KM)


def smembers(s: DataFrame, now_ms: int | None = None) -> DataFrame:
    return s if now_ms is None else live(s, now_ms)


def smismember(s: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, member) with `found`; the requests' other columns stay."""
    return asked.join(s.select(*KM).withColumn("__hit", F.lit(1)), KM, "left").withColumn("found", F.col("__hit").isNotNull().cast("int")).drop("__hit")


def scard(s: DataFrame, now_ms: int | None = None) -> DataFrame:
    return smembers(s, now_ms).groupBy("key").agg(F.count("*").alias("card"))


def spop(s: DataFrame, n: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): n pseudo-random members of each key."""
    order = [F.xxhash64(F.lit(seed), "member"), F.col("member")]
    popped = first_ranked(s, order, n).drop("rank")
    return popped, without(s, popped, KM)


def srandmember(s: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct members of each key, or -n with repeats."""
    if n >= 0:
        return spop(s, n, seed)[0]
    held = s.groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("all"))
    drawn = held.select("key", "all", F.explode(F.sequence(F.lit(1), F.lit(-n))).alias("draw"))
    return drawn.select("key", F.element_at("all", (F.floor(F.rand(seed) * F.size("all")) + 1).cast("int")).alias("member"))


def sscan(s: DataFrame, cursor: int = 0, count: int = 10, match: Column | None = None) -> DataFrame:
    r = first_ranked(s, [F.asc("member")], cursor + count).filter(F.col("rank") >= cursor)
    return r if match is None else r.filter(match)


def sinter(s: DataFrame, keys: Sequence[object]) -> DataFrame:
    """Members of all keys: one aggregate over the keys' rows, whatever their number."""
    keys = list(dict.fromkeys(keys))
    hit = s.filter(F.col("key").isin(keys)).groupBy("member").agg(F.count("*").alias("n"))
    return hit.filter(F.col("n") == len(keys)).select("member")


def sunion(s: DataFrame, keys: Sequence[object]) -> DataFrame:
    return s.filter(F.col("key").isin(list(keys))).select("member").distinct()


def sdiff(s: DataFrame, keys: Sequence[object]) -> DataFrame:
    """Members of the first key that no later one has: one aggregate."""
    first, rest = keys[0], [k for k in keys[1:]]
    if first in rest:
        return s.select("member").limit(0)
    hit = s.filter(F.col("key").isin(list(keys))).groupBy("member").agg(F.max(F.col("key") == lit(first)).alias("a"), F.max(F.col("key") != lit(first)).alias("b"))
    return hit.filter("a AND NOT b").select("member")


def sintercard(s: DataFrame, keys: Sequence[object], limit: int = 0) -> DataFrame:
    hit = sinter(s, keys)
    return (hit.limit(limit) if limit else hit).agg(F.count("*").alias("card"))


def sstore(s: DataFrame, key: object, members: DataFrame) -> DataFrame:
    """Next version in which key holds exactly members; no members: no key. Its old expiry goes."""
    return s.filter(F.col("key") != lit(key)).unionByName(members.select(lit(key).alias("key"), "member"), allowMissingColumns=True)


def smove(s: DataFrame, source: object, target: object, member: object) -> DataFrame:
    hit = (F.col("key") == lit(source)) & (F.col("member") == lit(member))
    moved = s.filter(hit).select(lit(target).alias("key"), "member")
    return s.filter(~hit).unionByName(moved, allowMissingColumns=True).dropDuplicates(KM)
