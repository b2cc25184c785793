"""Streams as tables: entries (key, id_ms, id_seq, ...[, deleted]), groups (key, grp, last_ms, last_seq),
consumers (key, grp, consumer, seen_ms) and pending entries (key, grp, id_ms, id_seq, consumer, delivery_ms, delivery_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.kernels import first_ranked, lit, ranked, running, upsert, without

ID = ["id_ms", "id_seq"]
PEL = ["key", "grp", *ID]
MAX = 2**63 - 1
NODE = 100  # entries of a node: approximate trims drop whole nodes only


def at_or_after(ms: int, seq: int = 0, *, exclusive: bool = False) -> Column:
    last = F.col("id_seq") > seq if exclusive else F.col("id_seq") >= seq
    return (F.col("id_ms") > ms) | ((F.col("id_ms") == ms) & last)


def at_or_before(ms: int, seq: int = MAX, *, exclusive: bool = False) -> Column:
    last = F.col("id_seq") < seq if exclusive else F.col("id_seq") <= seq
    return (F.col("id_ms") < ms) | ((F.col("id_ms") == ms) & last)


def present(x: DataFrame) -> DataFrame:
    return x.filter(~F.col("deleted")) if "deleted" in x.columns else x


def auto_ids(rows: DataFrame, order: str) -> DataFrame:
    """Entries with id_seq numbered within (key, id_ms) in arrival order."""
    w = W.partitionBy("key", "id_ms").orderBy(order)
    return rows.withColumn("id_seq", (F.row_number().over(w) - 1).cast("long"))


def xadd(x: DataFrame, new: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(next version, rejected): an entry must exceed every id before it, of the table and of the batch in order."""
    tops = x.groupBy("key").agg(F.max(F.struct(*ID)).alias("__top"))
    before = running(new.join(tops, "key", "left"), [F.asc(order)], F.struct(*ID), F.max, F.greatest, "__seen", last=-1)
    ok = F.struct(*ID) > F.greatest(F.coalesce("__top", F.struct(F.lit(-1).cast("long").alias("id_ms"), F.lit(-1).cast("long").alias("id_seq"))), F.coalesce("__seen", F.struct(F.lit(-1).cast("long").alias("id_ms"), F.lit(-1).cast("long").alias("id_seq"))))
    marked = before.withColumn("__ok", ok)
    accepted = marked.filter("__ok").drop("__ok", "__top", "__seen")
    return x.unionByName(accepted.drop(order) if order not in x.columns else accepted, allowMissingColumns=True), marked.filter("NOT __ok").drop("__ok", "__top", "__seen")


def xlen(x: DataFrame) -> DataFrame:
    return present(x).groupBy("key").agg(F.count("*").alias("length"))


def xrange(x: DataFrame, low: Column | None = None, high: Column | None = None, count: int | None = None, reverse: bool = False) -> DataFrame:
    """Entries within bounds (at_or_after, at_or_before), the first count of each key in (reverse) order of ids."""
    out = present(x)
    for bound in (low, high):
        if bound is not None:
            out = out.filter(bound)
    if count is None:
        return out
    order = [F.desc(c) if reverse else F.asc(c) for c in ID]
    return first_ranked(out, order, count).drop("rank")


def xdel(x: DataFrame, gone: DataFrame) -> DataFrame:
    """Next version with entries (key, id_ms, id_seq) as tombstones."""
    hit = gone.select("key", *ID).distinct().withColumn("__hit", F.lit(True))
    base = x if "deleted" in x.columns else x.withColumn("deleted", F.lit(False))
    return base.join(hit, ["key", *ID], "left").withColumn("deleted", F.coalesce("__hit", "deleted")).drop("__hit")


def xtrim_maxlen(x: DataFrame, n: int, *, approximate: bool = False, limit: int = 0) -> DataFrame:
    """The newest n entries of each key; approximate keeps whole nodes of 100 and drops at most limit entries (0: any number)."""
    r = ranked(x, [F.asc(c) for c in ID], length="__length")
    drop = F.greatest(F.col("__length") - n, F.lit(0))
    if approximate:
        drop = F.floor((F.least(drop, F.lit(limit)) if limit else drop) / NODE) * NODE
    return r.filter(F.col("rank") >= drop).drop("rank", "__length")


def xtrim_minid(x: DataFrame, ms: int, seq: int = 0, *, approximate: bool = False, limit: int = 0) -> DataFrame:
    if not approximate:
        return x.filter(at_or_after(ms, seq))
    old = x.groupBy("key").agg(F.count_if(~at_or_after(ms, seq)).alias("__old"))
    older = ranked(x, [F.asc(c) for c in ID]).join(old, "key")
    return older.filter(F.col("rank") >= F.floor((F.least(F.col("__old"), F.lit(limit)) if limit else F.col("__old")) / NODE) * NODE).drop("rank", "__old")


def xread(x: DataFrame, last: DataFrame, count: int | None = None) -> DataFrame:
    """Entries after each key's last id: last has (key, last_ms, last_seq)."""
    joined = present(x).join(last, "key")
    after = joined.filter((F.col("id_ms") > F.col("last_ms")) | ((F.col("id_ms") == F.col("last_ms")) & (F.col("id_seq") > F.col("last_seq")))).drop("last_ms", "last_seq")
    return after if count is None else first_ranked(after, [F.asc(c) for c in ID], count).drop("rank")


# ---- consumer groups -------------------------------------------------------------------------------------------------


def xgroup_create(groups: DataFrame, key: object, grp: str, ms: int = 0, seq: int = 0) -> DataFrame:
    new = groups.sparkSession.range(1).select(lit(key).alias("key"), F.lit(grp).alias("grp"), F.lit(ms).cast("long").alias("last_ms"), F.lit(seq).cast("long").alias("last_seq"))
    return groups.unionByName(without(new, groups, ["key", "grp"]), allowMissingColumns=True)


def xgroup_setid(groups: DataFrame, key: object, grp: str, ms: int, seq: int = 0) -> DataFrame:
    hit = (F.col("key") == lit(key)) & (F.col("grp") == grp)
    return groups.withColumn("last_ms", F.when(hit, F.lit(ms)).otherwise(F.col("last_ms"))).withColumn("last_seq", F.when(hit, F.lit(seq)).otherwise(F.col("last_seq")))


def xgroup_destroy(groups: DataFrame, key: object, grp: str) -> DataFrame:
    return groups.filter(~((F.col("key") == lit(key)) & (F.col("grp") == grp)))


def xreadgroup(x: DataFrame, groups: DataFrame, pending: DataFrame, grp: str, consumer: str, now_ms: int, count: int | None = None, *, noack: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(delivered, groups, pending): new entries of every key of the group go to the consumer."""
    mine = groups.filter(F.col("grp") == grp)
    got = xread(x, mine.select("key", "last_ms", "last_seq"), count)
    tops = got.groupBy("key").agg(F.max(F.struct(*ID)).alias("__t"))
    moved = groups.join(tops.withColumn("grp", F.lit(grp)), ["key", "grp"], "left")
    moved = moved.withColumn("last_ms", F.coalesce("__t.id_ms", "last_ms")).withColumn("last_seq", F.coalesce("__t.id_seq", "last_seq")).drop("__t")
    new = got.select("key", F.lit(grp).alias("grp"), *ID, F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("long").alias("delivery_ms"), F.lit(1).cast("long").alias("delivery_count"))
    return got, moved, pending if noack else upsert(pending, new, PEL)


def xreadgroup_history(pending: DataFrame, grp: str, consumer: str, now_ms: int, low: Column) -> DataFrame:
    """Next version of pending after a consumer re-reads its own entries: their delivery count rises."""
    hit = (F.col("grp") == grp) & (F.col("consumer") == consumer) & low
    return pending.withColumn("delivery_count", F.col("delivery_count") + hit.cast("long")).withColumn("delivery_ms", F.when(hit, F.lit(now_ms)).otherwise(F.col("delivery_ms")))


def xack(pending: DataFrame, acked: DataFrame) -> DataFrame:
    """acked: (key, grp, id_ms, id_seq)."""
    return without(pending, acked, PEL)


def xpending_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("pending"), F.min(F.struct(*ID)).alias("first"), F.max(F.struct(*ID)).alias("last"))


def xpending(pending: DataFrame, now_ms: int, *, min_idle: int = 0, low: Column | None = None, high: Column | None = None, count: int | None = None, consumer: str | None = None) -> DataFrame:
    out = pending.withColumn("idle_ms", F.lit(now_ms) - F.col("delivery_ms")).filter(F.col("idle_ms") >= min_idle)
    if consumer is not None:
        out = out.filter(F.col("consumer") == consumer)
    return xrange(out, low, high, count)


def xclaim(pending: DataFrame, asked: DataFrame, consumer: str, now_ms: int, min_idle: int, *, time_ms: int | None = None, retry_count: int | None = None, justid: bool = False) -> DataFrame:
    """Next version of pending: asked entries idle for min_idle go to consumer; justid leaves their delivery count."""
    hit = asked.select(*PEL).distinct().withColumn("__hit", F.lit(True))
    j = pending.join(hit, PEL, "left")
    take = F.coalesce(F.col("__hit"), F.lit(False)) & (F.lit(now_ms) - F.col("delivery_ms") >= min_idle)
    j = j.withColumn("__take", take)
    n = F.lit(retry_count) if retry_count is not None else F.col("delivery_count") + (0 if justid else 1)
    j = j.withColumn("consumer", F.when(F.col("__take"), F.lit(consumer)).otherwise(F.col("consumer")))
    j = j.withColumn("delivery_count", F.when(F.col("__take"), n).otherwise(F.col("delivery_count")).cast("long"))
    at = F.lit(time_ms if time_ms is not None else now_ms).cast("long")
    return j.withColumn("delivery_ms", F.when(F.col("__take"), at).otherwise(F.col("delivery_ms"))).drop("__hit", "__take")


def xautoclaim(x: DataFrame, pending: DataFrame, grp: str, consumer: str, now_ms: int, min_idle: int, low: Column, count: int = 100, justid: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claimed, deleted, pending): the first count idle entries of each key from a start; those whose entry is gone leave."""
    idle = pending.filter((F.col("grp") == grp) & low & (F.lit(now_ms) - F.col("delivery_ms") >= min_idle))
    picked = first_ranked(idle, [F.asc(c) for c in ID], count).drop("rank")
    here = present(x).select("key", *ID)
    deleted = picked.join(here, ["key", *ID], "left_anti").select(*PEL)
    kept = picked.join(here, ["key", *ID], "left_semi").select(*PEL)
    rest = xclaim(without(pending, deleted, PEL), kept, consumer, now_ms, min_idle, justid=justid)
    return rest.join(kept, PEL, "left_semi"), deleted, rest


# ---- what a stream remembers of entries that are gone ------------------------------------------------------------------

ZERO_ID = (0, 0)


def _id(ms: Column | int, seq: Column | int) -> Column:
    return F.struct(lit(ms).cast("long").alias("id_ms"), lit(seq).cast("long").alias("id_seq"))


def stream_meta(x: DataFrame) -> DataFrame:
    """(key, last_id, entries_added, max_deleted_id) of streams that were never trimmed: the metadata to begin with."""
    gone = F.col("deleted") if "deleted" in x.columns else F.lit(False)
    ids = F.struct(*[F.col(c).cast("long").alias(c) for c in ID])
    return x.groupBy("key").agg(F.max(ids).alias("last_id"), F.count("*").cast("long").alias("entries_added"), F.coalesce(F.max(F.when(gone, ids)), _id(*ZERO_ID)).alias("max_deleted_id"))


def _merged(meta: DataFrame, delta: DataFrame) -> DataFrame:
    both = meta.select("key", "last_id", "entries_added", "max_deleted_id").unionByName(delta)
    return both.groupBy("key").agg(F.max("last_id").alias("last_id"), F.sum("entries_added").alias("entries_added"), F.max("max_deleted_id").alias("max_deleted_id"))


def xadd_meta(meta: DataFrame, x: DataFrame, new: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next table, next metadata, rejected): as xadd, but an id must also exceed the stream's last one, which trimming and
    deleting leave as it is."""
    remembered = meta.select("key", "last_id.id_ms", "last_id.id_seq")
    held = x.select("key", *ID).unionByName(remembered)
    accepted, rejected = xadd(held, new, order)
    fresh = new.join(rejected.select("key", order), ["key", order], "left_anti")
    added = fresh.groupBy("key").agg(F.max(_id(F.col("id_ms"), F.col("id_seq"))).alias("last_id"), F.count("*").alias("entries_added"), _id(*ZERO_ID).alias("max_deleted_id"))
    rows = fresh.drop(order) if order not in x.columns else fresh
    return x.unionByName(rows, allowMissingColumns=True), _merged(meta, added), rejected


def xdel_meta(meta: DataFrame, gone: DataFrame) -> DataFrame:
    """Metadata after XDEL of entries (key, id_ms, id_seq) that were there."""
    top = gone.groupBy("key").agg(_id(*ZERO_ID).alias("last_id"), F.lit(0).cast("long").alias("entries_added"), F.max(_id(F.col("id_ms"), F.col("id_seq"))).alias("max_deleted_id"))
    return _merged(meta, top)


def xsetid(meta: DataFrame, x: DataFrame, key: object, ms: int, seq: int = 0, entries_added: int | None = None, max_deleted: tuple[int, int] | None = None) -> DataFrame:
    """Metadata with the key's last id set; it must not be below the stream's top entry or its greatest deleted id."""
    top = present(x).filter(F.col("key") == lit(key)).groupBy("key").agg(F.max(_id(F.col("id_ms"), F.col("id_seq"))).alias("__top"))
    hit, new = F.col("key") == lit(key), _id(ms, seq)
    deleted = _id(*max_deleted) if max_deleted else F.col("max_deleted_id")
    error = lambda text: F.raise_error(F.lit(text)).cast("struct<id_ms:bigint,id_seq:bigint>")
    checked = F.when(new < F.col("__top"), error("The ID specified in XSETID is smaller than the target stream top item")).when(new < deleted, error("The ID specified in XSETID is smaller than the provided max_deleted_entry_id")).otherwise(new)
    out = meta.join(top, "key", "left").withColumn("last_id", F.when(hit, checked).otherwise(F.col("last_id")))
    if entries_added is not None:
        out = out.withColumn("entries_added", F.when(hit, F.lit(entries_added).cast("long")).otherwise(F.col("entries_added")))
    if max_deleted:
        out = out.withColumn("max_deleted_id", F.when(hit, deleted).otherwise(F.col("max_deleted_id")))
    return out.drop("__top")


def xinfo_stream(x: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """XINFO STREAM of every key; counts and last ids come from the metadata if it is given, so that a trim leaves them."""
    now = present(x).groupBy("key").agg(F.count("*").alias("length"), F.min(F.struct(*ID)).alias("first_entry"))
    known = stream_meta(x) if meta is None else meta
    out = known.join(now, "key", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    none = F.col("max_deleted_id") == _id(*ZERO_ID)
    return out.select("key", "length", "entries_added", "last_id", F.when(~none, F.col("max_deleted_id")).alias("max_deleted_id"), "first_entry")


def xgroup_createconsumer(consumers: DataFrame, key: object, grp: str, consumer: str, now_ms: int) -> DataFrame:
    """consumers (key, grp, consumer, seen_ms) with one more, unless it is there."""
    new = consumers.sparkSession.range(1).select(lit(key).alias("key"), F.lit(grp).alias("grp"), F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("long").alias("seen_ms"))
    return consumers.unionByName(without(new, consumers, ["key", "grp", "consumer"]))


def xgroup_delconsumer(consumers: DataFrame, pending: DataFrame, key: object, grp: str, consumer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(consumers, pending, one row with `dropped`): a consumer goes with its pending entries."""
    hit = (F.col("key") == lit(key)) & (F.col("grp") == grp) & (F.col("consumer") == consumer)
    return consumers.filter(~hit), pending.filter(~hit), pending.filter(hit).agg(F.count("*").alias("dropped"))


def xinfo_groups(x: DataFrame, groups: DataFrame, pending: DataFrame) -> DataFrame:
    """Groups with consumers, pending entries and lag (entries after the last delivered id)."""
    lag = groups.join(x.select("key", *ID), "key", "left").groupBy("key", "grp").agg(F.count_if((F.col("id_ms") > F.col("last_ms")) | ((F.col("id_ms") == F.col("last_ms")) & (F.col("id_seq") > F.col("last_seq")))).alias("lag"))
    held = pending.groupBy("key", "grp").agg(F.count("*").alias("pending"), F.count_distinct("consumer").alias("consumers"))
    return groups.join(lag, ["key", "grp"], "left").join(held, ["key", "grp"], "left").fillna(0, ["pending", "consumers", "lag"])


def xinfo_consumers(pending: DataFrame, now_ms: int, consumers: DataFrame | None = None) -> DataFrame:
    """Pending entries and idle time of each consumer; with the consumers' table also of those that have none."""
    if consumers is not None:
        held = pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("pending"), F.max("delivery_ms").alias("last"))
        both = consumers.join(held, ["key", "grp", "consumer"], "full")
        return both.select("key", "grp", "consumer", F.coalesce("pending", F.lit(0)).alias("pending"), (F.lit(now_ms) - F.greatest("seen_ms", "last")).alias("idle_ms"))
    return pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("pending"), (F.lit(now_ms) - F.max("delivery_ms")).alias("idle_ms"))
