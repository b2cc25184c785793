"""Hashes: tables (key, field, value[, expire_at_ms]) with one row per field. All keys are served at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import MAX_TTL_MS, first_ranked, format_double, last_by, lit, live, parse_double, parse_long, upsert, without

KF = ["key", "field"]


def hset(h: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(next version, (key, created)). The last of repeated fields, by `order`, counts; a field's own expiry goes."""
    new = last_by(new, KF, order).drop(order) if order else new.dropDuplicates(KF)
    created = new.join(h.select(*KF).withColumn("__old", F.lit(1)), KF, "left").groupBy("key").agg(F.count_if(F.col("__old").isNull()).alias("created"))
    return upsert(h, new, KF), created


def hsetnx(h: DataFrame, new: DataFrame) -> DataFrame:
    return h.unionByName(without(new.dropDuplicates(KF), h, KF), allowMissingColumns=True)


def hget(h: DataFrame, field: str) -> DataFrame:
    return h.filter(F.col("field") == field).select("key", "value")


def hmget(h: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per key with a column per field, null where missing: one aggregate with known columns."""
    picks = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return h.groupBy("key").agg(*picks)


def hdel(h: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(next version, (key, removed))."""
    hit = F.col("field").isin(list(fields))
    return h.filter(~hit), h.groupBy("key").agg(F.count_if(hit).alias("removed"))


def hlen(h: DataFrame, now_ms: int | None = None) -> DataFrame:
    return (h if now_ms is None else live(h, now_ms)).groupBy("key").agg(F.count("*").alias("length"))


def hgetall(h: DataFrame) -> DataFrame:
    """(key, all): a map of each key's fields."""
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return h.groupBy("key").agg(F.map_from_entries(entries).alias("all"))


def hkeys(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def hvals(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "value"))), lambda x: x["value"]).alias("values"))


def hexists(h: DataFrame, field: str) -> DataFrame:
    return h.groupBy("key").agg(F.max((F.col("field") == field).cast("int")).alias("found"))


def hstrlen(h: DataFrame, field: str) -> DataFrame:
    return hget(h, field).select("key", F.octet_length("value").alias("length"))


def hincrby(h: DataFrame, delta: DataFrame) -> DataFrame:
    """(key, field, by) added to integers; missing is 0; other text and overflow raise. Field expiries stay."""
    total = delta.groupBy(*KF).agg(F.sum("by").alias("by"))
    joined = total.join(h, KF, "left")
    old = F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.coalesce(parse_long(F.col("value")), F.raise_error(F.lit("hash value is not an integer")).cast("long")))
    rest = [c for c in h.columns if c not in (*KF, "value")]
    return upsert(h, joined.select(*KF, (old + F.col("by")).cast("string").alias("value"), *rest), KF)


def hincrbyfloat(h: DataFrame, delta: DataFrame) -> DataFrame:
    total = delta.groupBy(*KF).agg(F.sum("by").alias("by"))
    joined = total.join(h, KF, "left")
    old = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.coalesce(parse_double(F.col("value")), F.raise_error(F.lit("hash value is not a float")).cast("double")))
    rest = [c for c in h.columns if c not in (*KF, "value")]
    return upsert(h, joined.select(*KF, format_double(old + F.col("by")).alias("value"), *rest), KF)


def hsetex(h: DataFrame, new: DataFrame, ttl_seconds: int, now_ms: int, *, guard: str | None = None, keep_ttl: bool = False) -> DataFrame:
    """Set fields with an expiry. guard: NX (per field: absent), FNX (per key: none exists) or FXX (per key: all exist)."""
    alive = live(h, now_ms)
    at = F.lit(now_ms + 1000 * ttl_seconds).cast("long")
    marked = new.dropDuplicates(KF).join(alive.select(*KF, F.col("expire_at_ms").alias("__old_at"), F.lit(1).alias("__old")), KF, "left")
    marked = marked.withColumn("expire_at_ms", F.when(F.lit(keep_ttl) & F.col("__old").isNotNull(), F.col("__old_at")).otherwise(at))
    if guard == "NX":
        marked = marked.filter(F.col("__old").isNull())
    elif guard in ("FNX", "FXX"):
        test = F.bool_and(F.col("__old").isNull() if guard == "FNX" else F.col("__old").isNotNull())
        marked = marked.join(marked.groupBy("key").agg(test.alias("ok")).filter("ok").select("key"), "key", "left_semi")
    return upsert(alive, marked.select(*KF, "value", "expire_at_ms"), KF)


def expire_reply(old_at: Column, new_at: Column, now_ms: int, condition: str | None) -> Column:
    """Reply of HEXPIRE for an existing field: 2 deleted, 1 set, 0 condition not met. No expiry counts as infinite."""
    infinite = F.lit(2**63 - 1)
    old = F.coalesce(old_at, infinite)
    met = {None: F.lit(True), "NX": old_at.isNull(), "XX": old_at.isNotNull(), "GT": new_at > old, "LT": new_at < old}[condition]
    return F.when(~met, 0).when(new_at <= F.lit(now_ms), 2).otherwise(1)


def hexpire(h: DataFrame, asked: DataFrame, seconds: int, now_ms: int, condition: str | None = None) -> DataFrame:
    """asked (key, field) with `reply`: -2 no field, else as expire_reply, and the new `expire_at_ms`."""
    alive = live(h, now_ms)
    new_at = F.lit(now_ms + min(1000 * seconds, MAX_TTL_MS)).cast("long")
    joined = asked.join(alive.select(*KF, F.col("expire_at_ms").alias("__at"), F.lit(1).alias("__hit")), KF, "left")
    reply = F.when(F.col("__hit").isNull(), -2).otherwise(expire_reply(F.col("__at"), new_at, now_ms, condition))
    out = joined.withColumn("reply", reply)
    return out.withColumn("expire_at_ms", F.when(F.col("reply") == 1, new_at).otherwise(F.col("__at"))).drop("__at", "__hit")


def httl(h: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """Seconds left of asked (key, field): -2 missing, -1 no expiry."""
    joined = asked.join(live(h, now_ms).select(*KF, "expire_at_ms", F.lit(1).alias("__hit")), KF, "left")
    left = F.floor((F.col("expire_at_ms") - lit(now_ms)) / 1000)
    return joined.select(*KF, F.when(F.col("__hit").isNull(), -2).when(F.col("expire_at_ms").isNull(), -1).otherwise(left).cast("long").alias("ttl"))


def hpexpiretime(h: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    joined = asked.join(live(h, now_ms).select(*KF, "expire_at_ms", F.lit(1).alias("__hit")), KF, "left")
    return joined.select(*KF, F.when(F.col("__hit").isNull(), -2).otherwise(F.coalesce("expire_at_ms", F.lit(-1))).cast("long").alias("at_ms"))


def hgetex(h: DataFrame, asked: DataFrame, now_ms: int, *, ttl_ms: int | None = None, persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """(values, next version): read fields and re-arm (or drop) their expiry; a past expiry deletes but still replies."""
    alive = live(h, now_ms)
    hit = alive.join(asked.select(*KF).distinct(), KF, "left_semi")
    if not persist and ttl_ms is None:
        return hit, alive
    at = F.lit(None).cast("long") if persist else F.lit(now_ms + ttl_ms).cast("long")
    return hit, live(upsert(alive, hit.withColumn("expire_at_ms", at), KF), now_ms)


def hrandfield(h: DataFrame, n: int, seed: int = 0) -> DataFrame:
    if n >= 0:
        return first_ranked(h, [F.xxhash64(F.lit(seed), "field"), F.col("field")], n).drop("rank")
    held = h.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("all"))
    drawn = held.select("key", "all", F.explode(F.sequence(F.lit(1), F.lit(-n))).alias("draw"))
    one = F.element_at("all", (F.floor(F.rand(seed) * F.size("all")) + 1).cast("int"))
    return drawn.select("key", one.alias("p")).select("key", "p.field", "p.value")


def hscan(h: DataFrame, cursor: int = 0, count: int = 10, match: Column | None = None) -> DataFrame:
    r = first_ranked(h, [F.asc("field")], cursor + count).filter(F.col("rank") >= cursor)
    return r if match is None else r.filter(match)
