"""Sorted sets: tables (key, member, score). Order is by score, then member. All keys are served at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import first_ranked, index_bounds, lit, ranked, upsert, without


def _order(reverse: bool = False) -> list[Column]:
    return [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]


def _one_each(new: DataFrame, order: str | None, nx: bool, gt: bool, lt: bool, incr: bool) -> DataFrame:
    """One row for each (key, member) of a batch, as its rows would leave it one after the other: increments add up, GT and
    LT keep the greatest or least, NX the first and others the last one in the order of a column. Without one, the
    greatest score counts as last and the least as first."""
    score = F.col("score")
    if incr:
        one = F.sum(score)
    elif gt or lt:
        one = F.max(score) if gt else F.min(score)
    elif order is not None:
        one = F.min_by(score, order) if nx else F.max_by(score, order)
    else:
        one = F.min(score) if nx else F.max(score)
    return new.groupBy("key", "member").agg(one.alias("score"))


def zadd(z: DataFrame, new: DataFrame, *, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False, order: str | None = None) -> DataFrame:
    """Next version with new (key, member, score); NX with GT or LT is refused, GT and LT still insert new members. A member
    may come repeatedly (see _one_each)."""
    if nx and (gt or lt):
        raise ValueError("GT, LT, and/or NX options at the same time are not compatible")
    new = _one_each(new, order, nx, gt, lt, incr)
    joined = new.alias("n").join(z.select("key", "member", F.col("score").alias("old")), ["key", "member"], "left")
    score = F.coalesce(F.col("old"), F.lit(0.0)) + F.col("score") if incr else F.col("score")
    joined = joined.withColumn("score", score)
    ok = F.lit(True)
    if nx:
        ok &= F.col("old").isNull()
    if xx:
        ok &= F.col("old").isNotNull()
    if gt:
        ok &= F.col("old").isNull() | (F.col("score") > F.col("old"))
    if lt:
        ok &= F.col("old").isNull() | (F.col("score") < F.col("old"))
    return upsert(z, joined.filter(ok).select("key", "member", "score"), ["key", "member"])


def zadd_reply(z: DataFrame, new: DataFrame, *, changed: bool = False, order: str | None = None) -> DataFrame:
    """(key, reply): members added, or with `changed` also those whose score changes; each counts once."""
    new = _one_each(new, order, False, False, False, False)
    joined = new.join(z.select("key", "member", F.col("score").alias("old")), ["key", "member"], "left")
    counts = F.col("old").isNull() | (F.lit(changed) & (F.col("old") != F.col("score")))
    return joined.groupBy("key").agg(F.count_if(counts).alias("reply"))


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    return without(z, gone, ["key", "member"])


def zscore(z: DataFrame, member: object) -> DataFrame:
    return z.filter(F.col("member") == lit(member)).select("key", "score")


def zmscore(z: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of (key, member) requests; null for missing ones."""
    return members.join(z, ["key", "member"], "left")


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("card"))


def zincrby(z: DataFrame, delta: DataFrame) -> DataFrame:
    """Next version with delta (key, member, by) added; a missing score is 0."""
    total = delta.groupBy("key", "member").agg(F.sum("by").alias("by"))
    moved = total.join(z, ["key", "member"], "left").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.col("by")).alias("score"))
    return upsert(z, moved, ["key", "member"])


def zrank(z: DataFrame, reverse: bool = False) -> DataFrame:
    return ranked(z, _order(reverse))


def zrange(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members of rank start to stop, negative ranks from the end."""
    if 0 <= start <= stop:
        return first_ranked(z, _order(reverse), stop + 1).filter(F.col("rank") >= start)
    r = ranked(z, _order(reverse), length="length")
    first, last = index_bounds(start, stop, F.col("length"))
    return r.filter((F.col("rank") >= first) & (F.col("rank") <= last)).drop("length")


def limited(z: DataFrame, offset: int, count: int, reverse: bool = False) -> DataFrame:
    """LIMIT: a negative offset gives nothing, a negative count has no bound."""
    if offset < 0:
        return z.limit(0)
    r = ranked(z, _order(reverse)) if count < 0 else first_ranked(z, _order(reverse), offset + count)
    return r.filter(F.col("rank") >= offset).drop("rank")


def score_between(low: float, high: float, *, open_low: bool = False, open_high: bool = False) -> Column:
    s = F.col("score")
    return (s > low if open_low else s >= low) & (s < high if open_high else s <= high)


def lex_between(low: object = None, high: object = None, *, open_low: bool = False, open_high: bool = False) -> Column:
    """Bounds of members; None stands for - or +."""
    m, out = F.col("member"), F.lit(True)
    if low is not None:
        out &= m > lit(low) if open_low else m >= lit(low)
    if high is not None:
        out &= m < lit(high) if open_high else m <= lit(high)
    return out


def zrangebyscore(z: DataFrame, low: float, high: float, *, open_low: bool = False, open_high: bool = False, offset: int | None = None, count: int = -1, reverse: bool = False) -> DataFrame:
    hit = z.filter(score_between(low, high, open_low=open_low, open_high=open_high))
    return hit if offset is None else limited(hit, offset, count, reverse)


def zrangebylex(z: DataFrame, low: object = None, high: object = None, *, open_low: bool = False, open_high: bool = False, offset: int | None = None, count: int = -1, reverse: bool = False) -> DataFrame:
    hit = z.filter(lex_between(low, high, open_low=open_low, open_high=open_high))
    return hit if offset is None else limited(hit, offset, count, reverse)


def zcount(z: DataFrame, where: Column) -> DataFrame:
    """(key, n) of members that satisfy a score or lex predicate; keys without any count 0."""
    return z.groupBy("key").agg(F.count_if(where).alias("n"))


def zremrange(z: DataFrame, where: Column) -> DataFrame:
    return z.filter(~where)


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    r = ranked(z, _order(), length="length")
    first, last = index_bounds(start, stop, F.col("length"))
    return r.filter((F.col("rank") < first) | (F.col("rank") > last)).drop("rank", "length")


def zpop(z: DataFrame, n: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest)."""
    popped = first_ranked(z, _order(highest), n)
    return popped, without(z, popped, ["key", "member"])


def zmpop(z: DataFrame, keys: Sequence[object], n: int = 1, highest: bool = False) -> DataFrame:
    """What is popped: from the first of keys, in order, that has members."""
    spark = z.sparkSession
    asked = spark.range(1).select(F.posexplode(F.array(*[lit(k) for k in keys])).alias("arg", "key"))
    held = F.broadcast(asked).join(z.select("key").distinct(), "key").agg(F.min_by("key", "arg").alias("key"))
    return zpop(z.join(F.broadcast(held), "key", "left_semi"), n, highest)[0]


def _weighted(inputs: Sequence[DataFrame], weights: Sequence[float] | None) -> DataFrame:
    out = None
    for k, z in enumerate(inputs):
        score = F.col("score") if "score" in z.columns else F.lit(1.0)  # members of plain sets score 1
        w = 1.0 if weights is None else float(weights[k])
        one = z.select("member", F.nanvl(score * F.lit(w), F.lit(0.0)).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def zcombine(inputs: Sequence[DataFrame], weights: Sequence[float] | None = None, aggregate: str = "SUM", intersect: bool = False) -> DataFrame:
    """ZUNION or ZINTER of tables (member, score): one shuffle for any number of inputs."""
    how = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[aggregate.upper()]
    grouped = _weighted(inputs, weights).groupBy("member").agg(how("score").alias("score"), F.count("*").alias("n"))
    if intersect:
        grouped = grouped.filter(F.col("n") == len(inputs))
    return grouped.select("member", F.nanvl("score", F.lit(0.0)).alias("score"))


def zdiff(first: DataFrame, rest: Sequence[DataFrame]) -> DataFrame:
    """Members of the first only, with its scores."""
    for other in rest:
        first = first.join(other.select("member"), "member", "left_anti")
    return first


def zintercard(inputs: Sequence[DataFrame], limit: int = 0) -> DataFrame:
    n = zcombine(inputs, intersect=True).agg(F.count("*").alias("card"))
    return n.select(F.least("card", F.lit(limit)).alias("card")) if limit else n


def zstore(z: DataFrame, key: object, result: DataFrame) -> DataFrame:
    """Next version in which key holds exactly result (member, score)."""
    return z.filter(F.col("key") != lit(key)).unionByName(result.select(lit(key).alias("key"), "member", "score"))


def zrandmember(z: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct members of each key, or -n with repeats."""
    if n >= 0:
        return first_ranked(z, [F.xxhash64(F.lit(seed), "member"), F.col("member")], n).drop("rank")
    held = z.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "member"))).alias("all"))
    drawn = held.select("key", "all", F.explode(F.sequence(F.lit(1), F.lit(-n))).alias("draw"))
    one = F.element_at("all", (F.floor(F.rand(seed) * F.size("all")) + 1).cast("int"))
    return drawn.select("key", one.alias("m")).select("key", "m.member", "m.score")


def zscan(z: DataFrame, cursor: int = 0, count: int = 10, match: Column | None = None) -> DataFrame:
    """A page of each key in order; the count budgets flat entries, a member and its score being two."""
    page = max(1, count // 2)
    r = first_ranked(z, _order(), cursor + page).filter(F.col("rank") >= cursor)
    return r if match is None else r.filter(match)
