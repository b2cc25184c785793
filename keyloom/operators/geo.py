"""Geospatial points: sorted sets whose score is the 52-bit interleaved cell of a point. Column expressions throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.kernels import first_ranked, lit

# Earth radius in metres, latitude limit of the projection, bits per axis, metres of the units, alphabet
RADIUS = 6372797.560856
LAT_MAX = 85.05112878
STEP = 26
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _shift(c: Column, n: int) -> Column:
    return F.call_function("shiftleft", c, F.lit(n)) if n >= 0 else F.call_function("shiftright", c, F.lit(-n))


MASKS = {s: sum(((1 << s) - 1) << 2 * s * k for k in range(32 // s)) for s in (1, 2, 4, 8, 16)}  # runs of s bits, s apart


def _folded(x: Column, steps: list[Column]) -> Column:
    """x through the steps one after the other: each names its input twice, so it is bound to a variable, not repeated."""
    return F.aggregate(F.array(*steps), x.cast("bigint"), lambda acc, s: acc.bitwiseOR(F.call_function("shiftleft", acc, s["up"])).bitwiseOR(F.call_function("shiftright", acc, s["down"])).bitwiseAND(s["mask"]))


def spread(x: Column) -> Column:
    """Bits of a number below 2^31 moved to the even places, by halves."""
    step = lambda s: F.struct(F.lit(s).alias("up"), F.lit(63).alias("down"), F.lit(MASKS[s]).cast("bigint").alias("mask"))
    return _folded(x, [step(s) for s in (16, 8, 4, 2, 1)])


def squash(x: Column) -> Column:
    """Inverse of spread: the even places' bits of a number below 2^62."""
    step = lambda s, mask: F.struct(F.lit(0).alias("up"), F.lit(s).alias("down"), F.lit(mask).cast("bigint").alias("mask"))
    return _folded(x.cast("bigint").bitwiseAND(F.lit(MASKS[1])), [step(1, MASKS[2]), step(2, MASKS[4]), step(4, MASKS[8]), step(8, MASKS[16]), step(16, (1 << 32) - 1)])


def cell(lon: Column, lat: Column, step: int = STEP, lat_max: float = LAT_MAX) -> Column:
    """Interleaved cell number: latitude in the even bits, longitude in the odd ones."""
    size = float(1 << step)
    y = F.floor((lat + lat_max) / (2 * lat_max) * size).cast("bigint")
    x = F.floor((lon + 180.0) / 360.0 * size).cast("bigint")
    return spread(y).bitwiseOR(_shift(spread(x), 1))


def position(score: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's middle."""
    bits = score.cast("bigint")
    y, x = squash(bits), squash(_shift(bits, -1))
    size = float(1 << STEP)
    lat = (y / size + (y + 1) / size) * LAT_MAX - LAT_MAX
    lon = (x / size + (x + 1) / size) * 180.0 - 180.0
    return lon, lat


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    u = F.sin((b - a) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * RADIUS * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))


def geoadd(points: DataFrame) -> DataFrame:
    """(key, member, lon, lat) -> (key, member, score); points outside the limits raise."""
    ok = F.col("lon").between(-180.0, 180.0) & F.col("lat").between(-LAT_MAX, LAT_MAX)
    score = F.when(ok, cell(F.col("lon"), F.col("lat")).cast("double")).otherwise(F.raise_error(F.lit("invalid longitude,latitude pair")).cast("double"))
    return points.select("key", "member", score.alias("score"))


def geopos(z: DataFrame) -> DataFrame:
    lon, lat = position(F.col("score"))
    return z.select("key", "member", lon.alias("lon"), lat.alias("lat"))


def geohash(z: DataFrame) -> DataFrame:
    """The 11-letter public hash: the middle encoded anew on latitudes of +-90; the last letter has no bits left."""
    lon, lat = position(F.col("score"))
    bits = cell(lon, lat, STEP, 90.0)
    letters = [F.lit(ALPHABET).substr(_shift(bits, -(52 - 5 * (i + 1))).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10)]
    return z.select("key", "member", F.concat(*letters, F.lit(ALPHABET[0])).alias("hash"))


def geodist(z: DataFrame, a: object, b: object, unit: str = "m") -> DataFrame:
    """(key, distance) between two members; null if one is missing."""
    lon, lat = position(F.col("score"))
    at = lambda m, c: F.max(F.when(F.col("member") == lit(m), c))
    g = z.groupBy("key").agg(at(a, lon).alias("x1"), at(a, lat).alias("y1"), at(b, lon).alias("x2"), at(b, lat).alias("y2"))
    return g.select("key", (distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / UNITS[unit]).alias("distance"))


def cover(lon: float, lat: float, width: float, height: float) -> list[tuple[int, int]]:
    """Score intervals of the cells around a point that hold a box of width x height metres: a plan-time index range."""
    dlat = math.degrees(height / 2 / RADIUS)
    near = min(LAT_MAX, abs(lat) + dlat)
    dlon = math.degrees(width / 2 / (RADIUS * max(1e-6, math.cos(math.radians(near)))))
    if dlon >= 90 or dlat >= 45:
        return [(0, 1 << 2 * STEP)]
    step = min(STEP, int(math.log2(min(360 / max(dlon * 2, 1e-9), 2 * LAT_MAX / max(dlat * 2, 1e-9)))))
    if step < 1:
        return [(0, 1 << 2 * STEP)]
    n = 1 << step
    y0 = max(0, int((lat - dlat + LAT_MAX) / (2 * LAT_MAX) * n))
    y1 = min(n - 1, int((lat + dlat + LAT_MAX) / (2 * LAT_MAX) * n))
    x0, x1 = int((lon - dlon + 180) / 360 * n // 1), int((lon + dlon + 180) / 360 * n // 1)
    out = set()
    for y in range(y0, y1 + 1):
        for x in range(x0 - (lon - dlon < -180), x1 + 1):
            xx, code = x % n, 0
            for k in range(step):
                code |= (y >> k & 1) << 2 * k | (xx >> k & 1) << 2 * k + 1
            out.add((code << 2 * (STEP - step), (code + 1) << 2 * (STEP - step)))
    return sorted(out)


def geosearch(z: DataFrame, lon: float, lat: float, *, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, descending: bool = False) -> DataFrame:
    """Members within a radius or a box (width, height) of a point, with `distance` in the unit.

    The score intervals of the cover are pushed down as range predicates; the exact test follows.
    """
    if count == 0:
        raise ValueError("COUNT must be > 0")
    scale = UNITS[unit]
    width, height = (2 * radius * scale, 2 * radius * scale) if radius is not None else (box[0] * scale, box[1] * scale)
    ranges = None
    for a, b in cover(lon, lat, width, height):
        one = (F.col("score") >= float(a)) & (F.col("score") < float(b))
        ranges = one if ranges is None else ranges | one
    x, y = position(F.col("score"))
    d = distance(F.lit(lon), F.lit(lat), x, y)
    if radius is not None:
        inside = d <= radius * scale
    else:
        inside = (distance(F.lit(lon), y, x, y) <= width / 2) & (distance(F.lit(lon), F.lit(lat), F.lit(lon), y) <= height / 2)
    hit = z.filter(ranges).filter(inside).withColumn("distance", d / scale)
    if count is None:
        return hit
    return first_ranked(hit, [F.desc("distance") if descending else F.asc("distance"), F.asc("member")], count).drop("rank")


def centre_of(z: DataFrame, key: object, member: object) -> tuple[float, float]:
    """The point of one member, a single row read at plan time, as FROMMEMBER needs it."""
    lon, lat = position(F.col("score"))
    row = z.filter((F.col("key") == lit(key)) & (F.col("member") == lit(member))).select(lon.alias("x"), lat.alias("y")).first()
    if row is None:
        raise LookupError("could not decode requested zset member")
    return row["x"], row["y"]


def georadiusbymember(z: DataFrame, key: object, member: object, radius: float, **options: object) -> DataFrame:
    """GEORADIUSBYMEMBER: members of the key within a radius of one of them."""
    return geosearch(z.filter(F.col("key") == lit(key)), *centre_of(z, key, member), radius=radius, **options)


def geosearchstore(z: DataFrame, target: object, hits: DataFrame, store_distance: bool = False) -> DataFrame:
    """Next version in which target holds exactly the hits, scored by cell or by distance."""
    score = F.col("distance") if store_distance else F.col("score")
    return z.filter(F.col("key") != lit(target)).unionByName(hits.select(lit(target).alias("key"), "member", score.alias("score")))
