"""Lists: tables (key, pos, value); pos only orders a key's elements, so pushes never renumber. All keys at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import first_ranked, index_bounds, lit, ranked, without

AT = ["key", "pos"]


def indexed(x: DataFrame, tail: bool = False) -> DataFrame:
    """With `rank` from the head (or the tail) and the key's `length`."""
    return ranked(x, [F.desc("pos") if tail else F.asc("pos")], length="length")


def push(x: DataFrame, new: DataFrame, order: str, *, head: bool = False, only_existing: bool = False) -> DataFrame:
    """Next version with new (key, value, order) pushed one after the other; at the head the last pushed comes first."""
    ends = x.groupBy("key").agg((F.min("pos") if head else F.max("pos")).alias("end"))
    placed = ranked(new, [F.asc(order)]).join(ends, "key", "inner" if only_existing else "left")
    step = F.col("rank") + 1
    start = F.coalesce("end", F.lit(0 if head else -1)).cast("double")
    return x.withColumn("pos", F.col("pos").cast("double")).unionByName(placed.select("key", (start - step if head else start + step).alias("pos"), "value"))


def pop(x: DataFrame, n: int = 1, *, tail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped with rank in order of popping, rest)."""
    if n < 0:
        raise ValueError("value is out of range, must be positive")
    order = [F.desc("pos") if tail else F.asc("pos")]
    popped = first_ranked(x, order, n)
    return popped, without(x, popped, AT)


def llen(x: DataFrame) -> DataFrame:
    return x.groupBy("key").agg(F.count("*").alias("length"))


def lrange(x: DataFrame, start: int, stop: int) -> DataFrame:
    if 0 <= start <= stop:
        return first_ranked(x, [F.asc("pos")], stop + 1).filter(F.col("rank") >= start)
    r = indexed(x)
    first, last = index_bounds(start, stop, F.col("length"))
    return r.filter((F.col("rank") >= first) & (F.col("rank") <= last)).drop("length")


def ltrim(x: DataFrame, start: int, stop: int) -> DataFrame:
    return lrange(x, start, stop).drop("rank")


def lindex(x: DataFrame, i: int) -> DataFrame:
    at = i if i >= 0 else -i - 1
    return first_ranked(x, [F.asc("pos") if i >= 0 else F.desc("pos")], at + 1).filter(F.col("rank") == at).select("key", "value")


def lset(x: DataFrame, i: int, value: object) -> DataFrame:
    at = i if i >= 0 else -i - 1
    hit = first_ranked(x, [F.asc("pos") if i >= 0 else F.desc("pos")], at + 1).filter(F.col("rank") == at).select(*AT, F.lit(True).alias("__hit"))
    return x.join(hit, AT, "left").withColumn("value", F.when(F.col("__hit"), lit(value)).otherwise(F.col("value"))).drop("__hit").select(*x.columns)


def lset_replies(x: DataFrame, i: int) -> DataFrame:
    """(key, reply) of LSET: OK, or the error of a key whose list is too short (which lset leaves as it is)."""
    short = F.col("length") <= (i if i >= 0 else -i - 1)
    return llen(x).select("key", F.when(short, "ERR index out of range").otherwise("OK").alias("reply"))


def lrem(x: DataFrame, count: int, value: object) -> DataFrame:
    """Without the first count occurrences of value (the last -count if negative, all if 0)."""
    same = F.col("value").eqNullSafe(lit(value))
    if count == 0:
        return x.filter(~same)
    r = ranked(x.withColumn("__same", same), [F.asc("pos") if count > 0 else F.desc("pos")], ["key", "__same"], "__nth")
    return r.filter(~(F.col("__same") & (F.col("__nth") < abs(count)))).drop("__same", "__nth")


def lpos(x: DataFrame, value: object, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """(key, index) of matches: from the rank-th on (from the tail if negative), count of them (0: all), among maxlen elements."""
    if rank == 0:
        raise ValueError("RANK can't be zero")
    r = indexed(x)
    back = F.col("length") - 1 - F.col("rank") if rank < 0 else F.col("rank")
    if maxlen:
        r = r.filter(back < maxlen)
    hit = r.filter(F.col("value") == lit(value))
    order = [F.desc("rank") if rank < 0 else F.asc("rank")]
    n = 1 if count is None else count
    hit = first_ranked(hit, order, abs(rank) + n - 1, name="nth") if n else ranked(hit, order, name="nth")
    return hit.select("key", F.col("rank").alias("index"), (F.col("nth") + 1).alias("nth")).filter(F.col("nth") >= abs(rank))


def linsert(x: DataFrame, pivot: object, value: object, *, before: bool = True) -> DataFrame:
    """Next version with value beside the first pivot of each key: its pos lies midway to the neighbour. Where no number is
    left between the two, the key's elements are numbered anew."""
    p = F.col("pos").cast("double")
    first = x.filter(F.col("value") == lit(pivot)).groupBy("key").agg(F.min(p).alias("pivot"))
    beside = x.join(first, "key").filter(p < F.col("pivot") if before else p > F.col("pivot"))
    near = beside.groupBy("key").agg((F.max(p) if before else F.min(p)).alias("near"))
    first = first.join(near, "key", "left")
    at = F.coalesce((F.col("pivot") + F.col("near")) / 2, F.col("pivot") + (-1 if before else 1))
    at = F.when((at == F.col("pivot")) | at.eqNullSafe(F.col("near")), None).otherwise(at)
    new = first.select("key", at.alias("pos"), lit(value).alias("value"), "pivot")
    full = new.filter("pos IS NULL").select("key", "pivot")
    tight = x.select("key", p.alias("pos"), "value").join(full.select("key"), "key", "left_semi").withColumn("side", F.lit(0))
    tight = tight.unionByName(full.select("key", F.col("pivot").alias("pos"), lit(value).alias("value"), F.lit(-1 if before else 1).alias("side")))
    anew = ranked(tight, [F.asc("pos"), F.asc("side")]).select("key", F.col("rank").cast("double").alias("pos"), "value")
    kept = x.select("key", p.alias("pos"), "value").join(full.select("key"), "key", "left_anti")
    return kept.unionByName(new.filter("pos IS NOT NULL").select("key", "pos", "value")).unionByName(anew)


def lmove(x: DataFrame, source: object, target: object, *, from_tail: bool = False, to_tail: bool = False) -> DataFrame:
    """Next version with one element moved from source's end to target's; equal keys rotate."""
    one = x.filter(F.col("key") == lit(source))
    taken, rest = pop(one, 1, tail=from_tail)
    others = x.filter(F.col("key") != lit(source)).unionByName(rest)
    return push(others, taken.select(lit(target).alias("key"), "value", F.lit(0).alias("o")), "o", head=not to_tail)


def lmpop(x: DataFrame, keys: Sequence[object], n: int = 1, *, tail: bool = False) -> DataFrame:
    """What is popped: from the first of keys, in order, that has elements."""
    asked = x.sparkSession.range(1).select(F.posexplode(F.array(*[lit(k) for k in keys])).alias("arg", "key"))
    held = F.broadcast(asked).join(x.select("key").distinct(), "key").agg(F.min_by("key", "arg").alias("key"))
    return pop(x.join(F.broadcast(held), "key", "left_semi"), n, tail=tail)[0]
