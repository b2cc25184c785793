"""Bitmaps: long tables (key, pos) of set bits, and expressions over binary values (bit 0 is the first byte's top bit)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import index_bounds, lit, ranked


def setbit(b: DataFrame, key: object, pos: int, bit: int) -> DataFrame:
    hit = (F.col("key") == lit(key)) & (F.col("pos") == pos)
    kept = b.filter(~hit)
    return kept.unionByName(b.sparkSession.range(1).select(lit(key).alias("key"), F.lit(pos).cast("long").alias("pos"))) if bit else kept


def getbit(b: DataFrame, pos: int) -> DataFrame:
    return b.groupBy("key").agg(F.max((F.col("pos") == pos).cast("int")).alias("bit"))


def bitcount(b: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Set bits of each key, in positions first to last if given."""
    where = F.lit(True)
    if first is not None:
        where &= F.col("pos") >= first
    if last is not None:
        where &= F.col("pos") <= last
    return b.groupBy("key").agg(F.count_if(where).alias("bits"))


def bitpos(b: DataFrame, bit: int = 1, start: int = 0) -> DataFrame:
    """First position from start on whose bit is `bit`; -1 for a key without one."""
    after = b.filter(F.col("pos") >= start)
    if bit:
        return b.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("pos") >= start, F.col("pos"))), F.lit(-1)).alias("pos"))
    # the first gap: positions of a run from start on keep pos - rank constant
    runs = after.select("key", "pos").distinct()
    r = ranked(runs, [F.asc("pos")])
    full = r.filter(F.col("pos") - F.col("rank") == start).groupBy("key").agg(F.max("pos").alias("last"))
    return b.select("key").distinct().join(full, "key", "left").select("key", F.coalesce(F.col("last") + 1, F.lit(start).cast("long")).alias("pos"))


SPAN = 1 << 16  # positions that one row of a complement is spread over


def bitop(b: DataFrame, op: str, keys: Sequence[object], n_bytes: int | None = None) -> DataFrame:
    """(pos) of the result; keys without any bit are skipped, as are missing ones. A key named twice counts twice for XOR.

    NOT covers n_bytes of the source; without it, the bytes up to the last set bit, as the table knows no more. Its
    positions are dealt to tasks in spans.
    """
    twice = [k for k in dict.fromkeys(keys) if keys.count(k) % 2 == 0]
    keys = list(dict.fromkeys(keys))
    hit = b.filter(F.col("key").isin(keys)).select("key", "pos").distinct()
    if op == "NOT":
        top = hit.agg(F.max("pos").alias("m")) if n_bytes is None else hit.sparkSession.range(1).select(F.lit(8 * n_bytes - 1).cast("long").alias("m"))
        last = F.col("m").bitwiseOR(F.lit(7))
        spans = top.filter("m >= 0").select(last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(SPAN).cast("long"))).alias("at")).repartition("at")
        every = spans.select(F.explode(F.sequence("at", F.least("last", F.col("at") + SPAN - 1))).alias("pos"))
        return every.join(hit, "pos", "left_anti").select("pos")
    grouped = hit.groupBy("pos").agg(F.count("*").alias("n"))
    if op == "OR":
        return grouped.select("pos")
    if op == "XOR":
        odd = hit.filter(~F.col("key").isin(twice)) if twice else hit
        return odd.groupBy("pos").agg(F.count("*").alias("n")).filter(F.col("n") % 2 == 1).select("pos")
    present = hit.select("key").distinct().agg(F.count("*").alias("present"))
    return grouped.join(F.broadcast(present), F.col("n") == F.col("present")).select("pos")


# ---- binary values --------------------------------------------------------------------------------------------------


def positions(value: Column) -> Column:
    """Array of the set positions of a binary value."""
    digits = F.hex(value.cast("binary"))
    nibble = lambda i: F.conv(F.substr(digits, i + 1, F.lit(1)), 16, 10).cast("int")
    every = F.sequence(F.lit(0), F.length(digits) * 4 - 1)
    set_ = F.filter(every, lambda p: F.getbit(nibble(F.floor(p / 4).cast("int")), F.lit(3) - p % 4) == 1)
    return F.when(F.length(digits) > 0, set_).otherwise(F.array().cast("array<int>"))


def exploded(s: DataFrame) -> DataFrame:
    """(key, pos) of binary values (key, value)."""
    return s.select("key", F.explode(positions(F.col("value"))).cast("long").alias("pos"))


def bitcount_of(value: Column, start: int = 0, stop: int = -1, *, bits: bool = False) -> Column:
    """BITCOUNT of a binary value over bytes (or bits) start to stop."""
    raw = value.cast("binary")
    n = F.octet_length(raw) * (8 if bits else 1)
    first, last = index_bounds(start, stop, n)
    if not bits:
        part = F.when(last >= first, raw.substr((first + 1).cast("int"), (last - first + 1).cast("int"))).otherwise(F.lit(b""))
        return F.size(positions(part))
    return F.size(F.filter(positions(raw), lambda p: (p >= first) & (p <= last)))


Sub = tuple


def bitfield(value: bytes | None, subs: Sequence[Sub]) -> tuple[bytes, list[int | None]]:
    """BITFIELD over one value. subs: ("GET", type, offset), ("SET"|"INCRBY", type, offset, n), ("OVERFLOW", mode).

    type is u1..u63 or i1..i64, offset a bit number or "#k" for the k-th field of that type.
    """
    data, mode, replies = bytearray(value or b""), "WRAP", []
    for sub in subs:
        if sub[0] == "OVERFLOW":
            mode = sub[1]
            continue
        signed, bits = sub[1][0] == "i", int(sub[1][1:])
        at = int(sub[2][1:]) * bits if isinstance(sub[2], str) and sub[2].startswith("#") else int(sub[2])
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
        end = (at + bits + 7) // 8
        whole = int.from_bytes(bytes(data[at // 8 : end]).ljust(end - at // 8, b"\0"), "big")
        shift = end * 8 - at - bits
        old = whole >> shift & ((1 << bits) - 1)
        old = old - (1 << bits) if signed and old > high else old
        if sub[0] == "GET":
            replies.append(old)
            continue
        new = int(sub[3]) + (old if sub[0] == "INCRBY" else 0)
        if not low <= new <= high:
            if mode == "FAIL":
                replies.append(None)
                continue
            new = max(low, min(high, new)) if mode == "SAT" else (new - low) % (1 << bits) + low
        data.extend(bytes(max(0, end - len(data))))
        whole = whole & ~(((1 << bits) - 1) << shift) | (new & ((1 << bits) - 1)) << shift
        data[at // 8 : end] = whole.to_bytes(end - at // 8, "big")
        replies.append(old if sub[0] == "SET" else new)
    return bytes(data), replies


def bitfield_all(s: DataFrame, subs: Sequence[Sub]) -> DataFrame:
    """(key, value, replies): the sub-operations applied to every key's value, in Arrow batches."""
    subs = [tuple(x) for x in subs]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = [bitfield(bytes(v) if v is not None else None, subs) for v in pdf["value"]]
            yield pd.DataFrame({"key": pdf["key"], "value": [d[0] for d in done], "replies": [d[1] for d in done]})

    kind = s.schema["key"].dataType.simpleString()
    return s.select("key", F.col("value").cast("binary").alias("value")).mapInPandas(run, f"key {kind}, value binary, replies array<bigint>")


def bitfield_ro(value: Column, kind: str, offset: int) -> Column:
    """GET of an unsigned or signed field of up to 56 bits as an expression (bytes beyond the end are 0)."""
    bits = int(kind[1:])
    first, end = offset // 8, (offset + bits + 7) // 8
    raw = F.rpad(F.hex(F.coalesce(value.cast("binary"), F.lit(b""))), 2 * end, "0")
    number = F.conv(raw.substr(2 * first + 1, 2 * (end - first)), 16, 10).cast("bigint")
    field = F.call_function("shiftright", number, F.lit(end * 8 - offset - bits)).bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(field >= (1 << bits - 1), field - (1 << bits)).otherwise(field) if kind[0] == "i" else field
