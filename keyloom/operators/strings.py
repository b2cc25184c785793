"""Strings: tables (key, value[, expire_at_ms]) with text or binary values. All keys are served at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import MAX_TTL_MS, format_double, index_bounds, last_by, lit, live, parse_double, parse_long, running, upsert, without


def set_(s: DataFrame, new: DataFrame, *, now_ms: int = 0, nx: bool = False, xx: bool = False, keep_ttl: bool = False, ttl_ms: int | None = None, at_ms: int | None = None, order: str | None = None) -> DataFrame:
    """SET: next version with new (key, value); a past at_ms deletes the keys instead, whatever NX or XX say."""
    if nx and xx or keep_ttl and (ttl_ms is not None or at_ms is not None) or ttl_ms is not None and at_ms is not None:
        raise ValueError("syntax error")
    if ttl_ms is not None and ttl_ms <= 0:
        raise ValueError("invalid expire time in 'set' command")
    new = last_by(new, ["key"], order).drop(order) if order else new.dropDuplicates(["key"])
    alive = live(s, now_ms)
    if at_ms is not None and at_ms <= now_ms:
        return without(alive, new, ["key"])
    if nx:
        new = without(new, alive, ["key"])
    if xx:
        new = new.join(alive.select("key"), "key", "left_semi")
    if "expire_at_ms" in s.columns:
        at = F.lit(at_ms if at_ms is not None else now_ms + min(ttl_ms, MAX_TTL_MS) if ttl_ms is not None else None).cast("long")
        if keep_ttl:
            new = new.join(alive.select("key", "expire_at_ms"), "key", "left")
        else:
            new = new.withColumn("expire_at_ms", at)
    return upsert(alive, new, ["key"])


def get(s: DataFrame, key: object) -> DataFrame:
    return s.filter(F.col("key") == lit(key)).select("value")


def mget(s: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, ...) with values, null where missing."""
    return asked.join(s.select("key", "value"), "key", "left")


def getdel(s: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return mget(s, asked), without(s, asked, ["key"])


def getset(s: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old values, next version); expiries stay."""
    rest = [c for c in s.columns if c not in ("key", "value")]
    kept = new.join(s.select("key", *rest), "key", "left") if rest else new
    return mget(s, new.select("key")), upsert(s, kept, ["key"])


def getex(s: DataFrame, asked: DataFrame, now_ms: int, *, ttl_ms: int | None = None, persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """(values, next version with the expiry changed)."""
    if ttl_ms is not None and not 0 < ttl_ms <= MAX_TTL_MS:
        raise ValueError("value is not an integer or out of range")
    alive = live(s, now_ms)
    hit = alive.join(asked.select("key").distinct(), "key", "left_semi")
    at = F.lit(None).cast("long") if persist else F.lit(now_ms + ttl_ms).cast("long") if ttl_ms is not None else F.col("expire_at_ms")
    return mget(alive, asked), upsert(alive, hit.withColumn("expire_at_ms", at), ["key"])


def setnx(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.unionByName(without(new.dropDuplicates(["key"]), s, ["key"]), allowMissingColumns=True)


def msetnx(s: DataFrame, new: DataFrame, *, all_or_nothing: bool = True) -> DataFrame:
    """Insert if none of the keys exists; without all_or_nothing the absent ones are written anyway."""
    if not all_or_nothing:
        return setnx(s, new)
    clash = new.join(s.select("key"), "key", "left_semi").agg((F.count("*") == 0).alias("ok"))
    fresh = new.dropDuplicates(["key"]).join(F.broadcast(clash.filter("ok")), F.lit(True), "left_semi")
    return s.unionByName(fresh, allowMissingColumns=True)


def append(s: DataFrame, log: DataFrame, order: str, *, front: bool = False) -> DataFrame:
    """Next version with log (key, value, order) appended (or put in front) one after the other."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))), lambda x: x["v"])
    added = log.groupBy("key").agg((F.reverse(parts) if front else parts).alias("parts"))
    text = F.array_join("parts", "")
    joined = s.join(added, "key", "full")
    old = F.coalesce("value", F.lit(""))
    new = F.when(F.col("parts").isNull(), F.col("value")).otherwise(F.concat(text, old) if front else F.concat(old, text))
    return joined.withColumn("value", new).drop("parts")


def strlen(s: DataFrame) -> DataFrame:
    return s.select("key", F.octet_length("value").alias("length"))


def substring_bytes(value: Column, start: int, stop: int) -> Column:
    """GETRANGE: bytes start to stop of a value, negative from the end; empty when out of range."""
    raw = value.cast("binary")
    first, last = index_bounds(start, stop, F.octet_length(raw).cast("int"))
    return F.when(last < first, F.lit(b"")).otherwise(raw.substr((first + 1).cast("int"), (last - first + 1).cast("int")))


def overwritten(value: Column, offset: int, patch: bytes) -> Column:
    """SETRANGE: bytes overwritten from offset on, zero-padded up to it; an empty patch changes nothing."""
    if offset < 0:
        raise ValueError("offset is out of range")
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    if not patch:
        return raw
    n = F.octet_length(raw)
    pad = F.when(n < offset, F.concat(raw, F.substring(F.lit(bytes(offset)), 1, offset).substr(F.lit(1), (F.lit(offset) - n).cast("int")))).otherwise(raw.substr(1, offset))
    return F.concat(pad, F.lit(patch), F.when(n > offset + len(patch), raw.substr(F.lit(offset + len(patch) + 1), n.cast("int"))).otherwise(F.lit(b"")))


def incrby(s: DataFrame, log: DataFrame) -> DataFrame:
    """(key, by) summed onto integers; missing or empty is 0; other text and overflow raise."""
    total = log.groupBy("key").agg(F.sum("by").alias("by"))
    joined = total.join(s, "key", "left")
    old = F.when(F.coalesce("value", F.lit("")) == "", F.lit(0)).otherwise(F.coalesce(parse_long(F.col("value")), F.raise_error(F.lit("value is not an integer or out of range")).cast("long")))
    rest = [c for c in s.columns if c not in ("key", "value")]
    return upsert(s, joined.select("key", (old + F.col("by")).cast("string").alias("value"), *rest), ["key"])


def incr_replies(log: DataFrame, order: str) -> DataFrame:
    """The counter after each increment of the log (counters start at 0): a running sum per key."""
    return running(log, [F.asc(order)], F.col("by"), F.sum, lambda a, b: F.coalesce(a + b, a, b), "reply")


def incrbyfloat(s: DataFrame, log: DataFrame, order: str) -> DataFrame:
    """Doubles added in order (as sums of doubles depend on it), stored as their shortest text."""
    added = log.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("by").cast("double").alias("by")))).alias("steps"))
    joined = added.join(s, "key", "left")
    old = F.when(F.coalesce("value", F.lit("")) == "", F.lit(0.0)).otherwise(F.coalesce(parse_double(F.col("value")), F.raise_error(F.lit("value is not a valid float")).cast("double")))
    total = F.aggregate("steps", old, lambda acc, x: acc + x["by"])
    rest = [c for c in s.columns if c not in ("key", "value")]
    return upsert(s, joined.select("key", format_double(total).alias("value"), *rest), ["key"])


def digest(s: DataFrame) -> DataFrame:
    """16 hex digits of XXH3-64 of each value, in Arrow batches."""
    import xxhash

    @F.pandas_udf("string")
    def xxh3(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else xxhash.xxh3_64_hexdigest(b))

    return s.select("key", xxh3(F.col("value").cast("binary")).alias("digest"))


NS = 1_000_000_000


def throttle_step(tat: int | None, now_ns: int, limit: int, interval: int, quantity: int) -> tuple[int | None, tuple[int, int, int, int, int]]:
    """One request of the generic cell rate algorithm: (new arrival time or None, (limited, limit, remaining, retry s, reset s))."""
    tat = now_ns if tat is None else tat
    tolerance, increment = interval * limit, interval * quantity
    new = max(tat, now_ns) + increment
    room = now_ns - (new - tolerance)
    seconds = lambda ms: ms // 1000 + 1 if ms > 0 else ms
    if room < 0:
        ttl = tat - now_ns
        retry = -1 if increment > tolerance else seconds(-(room // 1_000_000))
    else:
        ttl, retry = new - now_ns, -1
    left = tolerance - ttl
    remaining = int(left / interval) if left > -interval else 0
    return (None if room < 0 else new), (int(room < 0), limit, remaining, retry, seconds(-(-ttl // 1_000_000)))


def throttle(log: DataFrame, order: str, *, max_burst: int, count: int, period: int, quantity: int = 1) -> DataFrame:
    """log (key, order, now_ms) -> a reply row per request; the state is one arrival time per key.

    Requests are dealt by key, sorted and streamed, so a key's requests are never held together.
    """
    limit, interval = max_burst + 1, period * NS // count
    if interval == 0:
        raise ValueError("zero rates are not supported")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tat, seen = None, None, False
        for pdf in frames:
            out = []
            for k, o, now_ms in zip(pdf["key"], pdf["o"], pdf["now_ms"], strict=True):
                if not seen or k != key:
                    key, tat, seen = k, None, True
                now = int(now_ms) * 1_000_000
                if tat is not None and tat <= now:
                    tat = None  # its expiry has passed
                new, reply = throttle_step(tat, now, limit, interval, quantity)
                tat = tat if new is None else new
                out.append((k, o, *reply))
            yield pd.DataFrame(out, columns=["key", "o", "limited", "limit", "remaining", "retry_s", "reset_s"])

    kind = log.schema["key"].dataType.simpleString()
    dealt = log.select("key", F.col(order).cast("long").alias("o"), "now_ms").repartition("key").sortWithinPartitions("key", "now_ms", "o")
    return dealt.mapInPandas(run, f"key {kind}, o long, limited int, limit long, remaining long, retry_s long, reset_s long")
