"""The key table (db, key, type, expire_at_ms, sticky, ...) and operators that work on keys of any type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import MAX_TTL_MS, first_ranked, glob, lit, live, parse_double, ranked, without


def _identity(k: DataFrame, asked: DataFrame) -> list[str]:
    """What names a row of both tables: database and key, or the key alone where one of them has no database."""
    return ["db", "key"] if "db" in k.columns and "db" in asked.columns else ["key"]


def delete(k: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next version, one row with `removed`). gone names keys, or (db, key) pairs."""
    on = _identity(k, gone)
    return without(k, gone, on), k.join(gone.select(*on).distinct(), on, "left_semi").agg(F.count("*").alias("removed"))


def exists(k: DataFrame, asked: DataFrame) -> DataFrame:
    """One row with `found`: how many of the asked keys exist, repeats counted."""
    return asked.join(k.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("found"))


def touch(k: DataFrame, asked: DataFrame) -> DataFrame:
    hit = asked.select("key").distinct().withColumn("__hit", F.lit(True))
    return k.join(hit, "key", "left").withColumn("touched", F.coalesce(F.col("__hit"), F.col("touched"))).drop("__hit")


def stick(k: DataFrame, asked: DataFrame) -> DataFrame:
    hit = asked.select("key").distinct().withColumn("__hit", F.lit(True))
    return k.join(hit, "key", "left").withColumn("sticky", F.coalesce(F.col("__hit"), F.col("sticky"))).drop("__hit")


def delex(s: DataFrame, key: object, value: object, *, equal: bool = True) -> DataFrame:
    """Delete a string if its value equals (or differs from) one."""
    same = F.col("value") == lit(value)
    return s.filter(~((F.col("key") == lit(key)) & (same if equal else ~same)))


def expire_condition(old_at: Column, new_at: Column, options: Sequence[str]) -> Column:
    """Conditions are alternatives: any that holds suffices. No expiry counts as infinite."""
    if not options:
        return F.lit(True)
    old = F.coalesce(old_at, F.lit(2**63 - 1))
    tests = {"NX": old_at.isNull(), "XX": old_at.isNotNull(), "GT": new_at > old, "LT": new_at < old}
    out = F.lit(False)
    for o in options:
        out |= tests[o]
    return out


def expire(k: DataFrame, at_ms: Column | int, now_ms: int, options: Sequence[str] = ()) -> DataFrame:
    """Next version with expiries set at at_ms where the conditions hold (clamped to the longest); past ones delete."""
    new_at = F.least(lit(at_ms).cast("long"), F.lit(now_ms + MAX_TTL_MS))
    ok = expire_condition(F.col("expire_at_ms"), new_at, options)
    moved = k.withColumn("expire_at_ms", F.when(ok, new_at).otherwise(F.col("expire_at_ms")))
    return live(moved, now_ms)


def expire_replies(k: DataFrame, at_ms: Column | int, options: Sequence[str] = ()) -> DataFrame:
    return k.select("key", expire_condition(F.col("expire_at_ms"), lit(at_ms), options).cast("int").alias("reply"))


def persist(k: DataFrame, asked: DataFrame) -> DataFrame:
    hit = asked.select("key").distinct().withColumn("__hit", F.lit(True))
    return k.join(hit, "key", "left").withColumn("expire_at_ms", F.when(F.col("__hit").isNull(), F.col("expire_at_ms"))).drop("__hit")


def ttl(k: DataFrame, now_ms: int) -> DataFrame:
    """Seconds left, rounded half up; -1 without expiry. (A key that is missing or dead has no row: -2 on a left join.)"""
    left = F.floor((F.col("expire_at_ms") - now_ms + 500) / 1000)
    return live(k, now_ms).select("key", F.coalesce(left, F.lit(-1)).cast("long").alias("ttl"))


def pttl(k: DataFrame, now_ms: int) -> DataFrame:
    return live(k, now_ms).select("key", F.coalesce(F.col("expire_at_ms") - now_ms, F.lit(-1)).cast("long").alias("pttl"))


def ttl_of(k: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    return asked.join(ttl(k, now_ms), "key", "left").withColumn("ttl", F.coalesce("ttl", F.lit(-2)))


def expiretime(k: DataFrame) -> DataFrame:
    return k.select("key", F.coalesce(F.floor((F.col("expire_at_ms") + 500) / 1000), F.lit(-1)).cast("long").alias("at_s"))


def pexpiretime(k: DataFrame) -> DataFrame:
    return k.select("key", F.coalesce("expire_at_ms", F.lit(-1)).cast("long").alias("at_ms"))


def type_of(k: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(k.select("key", "type"), "key", "left").withColumn("type", F.coalesce("type", F.lit("none")))


def matching(k: DataFrame, pattern: str) -> DataFrame:
    """KEYS: expiry is not checked."""
    return k.filter(glob(F.col("key"), pattern))


def move(k: DataFrame, key: object, source: int, target: int) -> DataFrame:
    """Next version with key moved to another database, unless it is taken there."""
    hit = (F.col("db") == source) & (F.col("key") == lit(key))
    taken = k.filter((F.col("db") == target) & (F.col("key") == lit(key))).select("key")
    moved = k.filter(hit).join(taken, "key", "left_anti").withColumn("db", F.lit(target))
    stays = k.filter(hit).join(taken, "key", "left_semi")
    return k.filter(~hit).unionByName(stays).unionByName(moved.select(*k.columns))


def rename(t: DataFrame, old: object, new: object, *, only_free: bool = False) -> DataFrame:
    """Next version of any table with column key: old's rows become new's, whose own rows go (unless only_free finds any)."""
    is_old, is_new = F.col("key") == lit(old), F.col("key") == lit(new)
    source = t.filter(is_old).withColumn("key", lit(new)).select(*t.columns)
    if only_free:
        taken = t.filter(is_new).select("key").distinct()
        return t.filter(~is_old).unionByName(source.join(taken, "key", "left_anti").select(*t.columns)).unionByName(t.filter(is_old).join(taken.select(lit(old).alias("key")), "key", "left_semi").select(*t.columns))
    missing = t.filter(is_new).join(source.select("key").distinct(), "key", "left_anti").select(*t.columns)
    return t.filter(~is_old & ~is_new).unionByName(missing).unionByName(source)


def copy(t: DataFrame, old: object, new: object, *, replace: bool = False) -> DataFrame:
    is_new = F.col("key") == lit(new)
    source = t.filter(F.col("key") == lit(old)).withColumn("key", lit(new)).select(*t.columns)
    if replace:
        missing = t.filter(is_new).join(source.select("key").distinct(), "key", "left_anti").select(*t.columns)
        return t.filter(~is_new).unionByName(missing).unionByName(source)
    return t.unionByName(source.join(t.filter(is_new).select("key").distinct(), "key", "left_anti").select(*t.columns))


def randomkey(k: DataFrame, seed: int = 0) -> DataFrame:
    return k.select("key").orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1)


def scan(k: DataFrame, cursor: Sequence | None = None, count: int = 10, *, match: str = "*", type_: str | None = None, attr: str | None = None, min_bytes: int | None = None) -> DataFrame:
    """A page of keys in hash order after cursor (the last page's greatest `cursor`), by keyset: no offset is counted.

    A cursor is (hash, db, key), so a page may end between keys of equal hash and between databases that hold one key.
    attr: v (expiring), p (permanent), a (accessed), u (untouched).
    """
    db = F.col("db").cast("int") if "db" in k.columns else F.lit(0)
    place = lambda h, d, x: F.struct(h.alias("hash"), d.alias("db"), x.alias("key"))
    out = k.withColumn("cursor", place(F.xxhash64("key"), db, F.col("key")))
    if type_:
        out = out.filter(F.col("type") == type_)
    tests = {"v": F.col("expire_at_ms").isNotNull(), "p": F.col("expire_at_ms").isNull()}
    if "touched" in k.columns:
        tests |= {"a": F.col("touched"), "u": ~F.col("touched")}
    if attr:
        out = out.filter(tests[attr])
    if min_bytes is not None:
        out = out.filter(F.col("bytes") >= min_bytes)
    if match != "*":
        out = out.filter(glob(F.col("key"), match))
    if cursor is not None:
        h, d, x = cursor
        out = out.filter(F.col("cursor") > place(F.lit(h).cast("long"), F.lit(d).cast("int"), lit(x).cast(k.schema["key"].dataType)))
    return out.orderBy("cursor").limit(count)


def rm(k: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:
    """(removed page, next version)."""
    page = scan(k, **options)
    return page, without(k, page, _identity(k, page))


def sort(elements: DataFrame, *, by: DataFrame | None = None, get: DataFrame | None = None, alpha: bool = False, descending: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    """SORT of every key's elements (key, value): (key, rank, value[, got]).

    by and get are lookup tables (value, weight) and (value, got) of the patterns' keys; a missing weight is 0.
    Ties are broken by the text, also when descending. Text that is no number raises unless alpha.
    """
    text = F.col("value").cast("string")
    rows = elements
    if by is not None:
        rows = rows.join(by, "value", "left")
        weight = F.col("weight").cast("string")
        number = F.when(weight.isNull(), F.lit(0.0)).otherwise(F.coalesce(parse_double(weight), F.raise_error(F.lit("One or more scores can't be converted into double")).cast("double")))
        main = F.coalesce(weight, F.lit("")) if alpha else number
    else:
        main = text if alpha else F.coalesce(parse_double(text), F.raise_error(F.lit("One or more scores can't be converted into double")).cast("double"))
    rows = rows.withColumn("__main", main).withColumn("__text", text)
    order = [F.desc("__main"), F.desc("__text")] if descending else [F.asc("__main"), F.asc("__text")]
    rows = first_ranked(rows, order, offset + count) if count >= 0 else ranked(rows, order)
    if offset:
        rows = rows.filter(F.col("rank") >= offset)
    out = rows.drop("__main", "__text", "weight")
    return out if get is None else out.join(get, "value", "left")


def fieldexpire(t: DataFrame, column: str, asked: DataFrame, seconds: int, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(next version, asked with reply 1 or -2): expiry of a set's members or a hash's fields, named by `column`."""
    keys = ["key", column]
    alive = live(t, now_ms)
    hit = asked.select(*keys).distinct().withColumn("__hit", F.lit(1))
    at = F.lit(now_ms + 1000 * seconds).cast("long")
    out = alive.join(hit, keys, "left").withColumn("expire_at_ms", F.when(F.col("__hit") == 1, at).otherwise(F.col("expire_at_ms"))).drop("__hit")
    reply = asked.join(alive.select(*keys, F.lit(1).alias("__hit")), keys, "left").withColumn("reply", F.coalesce("__hit", F.lit(-2))).drop("__hit")
    return out, reply


def fieldttl(t: DataFrame, column: str, asked: DataFrame, now_ms: int) -> DataFrame:
    """Seconds left (floor) of asked (key, column): -2 no key, -3 no field, -1 no expiry."""
    keys = ["key", column]
    alive = live(t, now_ms)
    joined = asked.join(alive.select(*keys, "expire_at_ms", F.lit(1).alias("__hit")), keys, "left").join(alive.select("key").distinct().withColumn("__key", F.lit(1)), "key", "left")
    left = F.floor((F.col("expire_at_ms") - now_ms) / 1000)
    reply = F.when(F.col("__key").isNull(), -2).when(F.col("__hit").isNull(), -3).when(F.col("expire_at_ms").isNull(), -1).otherwise(left)
    return joined.select(*keys, reply.cast("long").alias("ttl"))
