"""Sorted-set and geospatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import geo as g
from keyloom.operators import zsets as z
from keyloom.plans.views import geo, query, st, table, zst

RANK = "row_number() OVER (PARTITION BY key ORDER BY score, member) - 1"
BACK = "row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1"
KMS = ["key", "member", "score"]


def by_priority(s, d, p):
    """A sorted set of customers by their spending at one order priority."""
    o = table(s, d, "orders").filter(F.col("o_orderpriority") == p)
    return o.groupBy(F.col("o_custkey").alias("member")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))


PRI = "{n} AS (SELECT o_custkey AS member, round(sum(o_totalprice), 2) AS score FROM orders WHERE o_orderpriority = '{p}' GROUP BY 1)"
PRIS = "WITH " + ", ".join(PRI.format(n=n, p=p) for n, p in (("a", "1-URGENT"), ("b", "2-HIGH"), ("c", "3-MEDIUM")))


def three(s, d):
    return [by_priority(s, d, p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")]


def rounded(df):
    return df.withColumn("score", F.round("score", 4))


query("zrank", "zst", f"SELECT key, member, score, {RANK} AS rank FROM zst")(lambda s, d: z.zrank(zst(s, d)))
query("zrevrank", "zst", f"SELECT key, member, score, {BACK} AS rank FROM zst")(lambda s, d: z.zrank(zst(s, d), reverse=True))
query("zrange_rank", "zst", f"SELECT * FROM (SELECT key, member, score, {RANK} AS rank FROM zst) WHERE rank BETWEEN 2 AND 5")(lambda s, d: z.zrange(zst(s, d), 2, 5))
query("zrange_negative", "zst", f"SELECT key, member, score, rank FROM (SELECT key, member, score, {RANK} AS rank, count(*) OVER (PARTITION BY key) AS n FROM zst) WHERE rank BETWEEN n - 3 AND n - 1")(lambda s, d: z.zrange(zst(s, d), -3, -1))
query("zrevrange_top10", "zst", f"SELECT * FROM (SELECT key, member, score, {BACK} AS rank FROM zst) WHERE rank <= 9")(lambda s, d: z.zrange(zst(s, d), 0, 9, reverse=True))
query("zrangebyscore", "zst", "SELECT * FROM zst WHERE score > 1000 AND score <= 5000")(lambda s, d: z.zrangebyscore(zst(s, d), 1000.0, 5000.0, open_low=True))
query("zrangebyscore_limit", "zst", f"SELECT key, member, score FROM (SELECT *, {RANK} AS r FROM zst WHERE score >= 0) WHERE r BETWEEN 3 AND 7")(lambda s, d: z.zrangebyscore(zst(s, d), 0.0, float("inf"), offset=3, count=5))
query("zrevrangebyscore_limit", "zst", f"SELECT key, member, score FROM (SELECT *, {BACK} AS r FROM zst WHERE score < 9000) WHERE r < 4")(lambda s, d: z.zrangebyscore(zst(s, d), float("-inf"), 9000.0, open_high=True, offset=0, count=4, reverse=True))
query("zrangebylex", "zst", "SELECT * FROM zst WHERE member >= 100 AND member < 900")(lambda s, d: z.zrangebylex(zst(s, d), 100, 900, open_high=True))
query("zrevrangebylex_limit", "zst", f"SELECT key, member, score FROM (SELECT *, {BACK} AS r FROM zst WHERE member > 50) WHERE r < 3")(lambda s, d: z.zrangebylex(zst(s, d), 50, None, open_low=True, offset=0, count=3, reverse=True))
query("zcount", "zst", "SELECT key, count(*) FILTER (score BETWEEN 0 AND 2500) AS n FROM zst GROUP BY key")(lambda s, d: z.zcount(zst(s, d), z.score_between(0.0, 2500.0)))
query("zlexcount", "zst", "SELECT key, count(*) FILTER (member >= 500) AS n FROM zst GROUP BY key")(lambda s, d: z.zcount(zst(s, d), z.lex_between(500)))
query("zcard", "zst", "SELECT key, count(*) AS card FROM zst GROUP BY key")(lambda s, d: z.zcard(zst(s, d)))
query("zscore", "zst", "SELECT key, score FROM zst WHERE member = 77")(lambda s, d: z.zscore(zst(s, d), 77))
query("zmscore", "zst", "SELECT n.key, n.member, score FROM (SELECT c_nationkey AS key, unnest([1, 50, 99]) AS member FROM (SELECT DISTINCT c_nationkey FROM customer)) n LEFT JOIN zst USING (key, member)")(
    lambda s, d: z.zmscore(zst(s, d), zst(s, d).select("key").distinct().select("key", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 50, 99)])).alias("member")))
)
NEW = "SELECT c_nationkey AS key, c_custkey AS member, round(c_acctbal * -1, 2) AS score FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_nationkey, c_custkey + 1000000, 1.5 FROM customer WHERE c_custkey % 50 = 0"


def fresh(s, d):
    c = zst(s, d)
    return c.filter("member % 7 = 0").select("key", "member", F.round(-F.col("score"), 2).alias("score")).unionByName(c.filter("member % 50 = 0").select("key", (F.col("member") + 1_000_000).alias("member"), F.lit(1.5).alias("score")))


MERGED = f"SELECT coalesce(n.key, o.key) AS key, coalesce(n.member, o.member) AS member, CASE WHEN n.key IS NULL THEN o.score WHEN o.key IS NULL THEN {{new}} ELSE {{both}} END AS score FROM zst o FULL JOIN ({NEW}) n ON n.key = o.key AND n.member = o.member"
query("zadd", "zst", MERGED.format(new="n.score", both="n.score"))(lambda s, d: z.zadd(zst(s, d), fresh(s, d)))
query("zadd_nx", "zst", MERGED.format(new="n.score", both="o.score"))(lambda s, d: z.zadd(zst(s, d), fresh(s, d), nx=True))
query("zadd_xx", "zst", MERGED.format(new="n.score", both="n.score") + " WHERE o.key IS NOT NULL")(lambda s, d: z.zadd(zst(s, d), fresh(s, d), xx=True))
query("zadd_gt", "zst", MERGED.format(new="n.score", both="greatest(n.score, o.score)"))(lambda s, d: z.zadd(zst(s, d), fresh(s, d), gt=True))
query("zadd_lt", "zst", MERGED.format(new="n.score", both="least(n.score, o.score)"))(lambda s, d: z.zadd(zst(s, d), fresh(s, d), lt=True))
query("zadd_reply", "zst", f"SELECT n.key, count(*) FILTER (o.key IS NULL) AS reply FROM ({NEW}) n LEFT JOIN zst o ON n.key = o.key AND n.member = o.member GROUP BY 1")(lambda s, d: z.zadd_reply(zst(s, d), fresh(s, d)))
query("zincrby", "zst", "SELECT key, member, round(CASE WHEN member % 4 = 0 THEN score + 10.5 ELSE score END, 4) AS score FROM zst")(lambda s, d: rounded(z.zincrby(zst(s, d), zst(s, d).filter("member % 4 = 0").select("key", "member", F.lit(10.5).alias("by")))))
query("zrem", "zst", "SELECT * FROM zst WHERE member % 10 <> 0")(lambda s, d: z.zrem(zst(s, d), zst(s, d).filter("member % 10 = 0")))
query("zpopmin", "zst", f"SELECT * FROM (SELECT key, member, score, {RANK} AS rank FROM zst) WHERE rank < 3")(lambda s, d: z.zpop(zst(s, d), 3)[0])
query("zpopmin_rest", "zst", f"SELECT key, member, score FROM (SELECT key, member, score, {RANK} AS rank FROM zst) WHERE rank >= 3")(lambda s, d: z.zpop(zst(s, d), 3)[1])
query("zpopmax", "zst", f"SELECT * FROM (SELECT key, member, score, {BACK} AS rank FROM zst) WHERE rank < 2")(lambda s, d: z.zpop(zst(s, d), 2, highest=True)[0])
query("zmpop", "zst", f"SELECT * FROM (SELECT key, member, score, {RANK} AS rank FROM zst WHERE key = 3) WHERE rank < 2")(lambda s, d: z.zmpop(zst(s, d), [99, 3, 4], 2))
query("zremrangebyrank", "zst", f"SELECT key, member, score FROM (SELECT key, member, score, {RANK} AS rank FROM zst) WHERE rank > 4")(lambda s, d: z.zremrangebyrank(zst(s, d), 0, 4))
query("zremrangebyscore", "zst", "SELECT * FROM zst WHERE NOT score BETWEEN 0 AND 3000")(lambda s, d: z.zremrange(zst(s, d), z.score_between(0.0, 3000.0)))
query("zremrangebylex", "zst", "SELECT * FROM zst WHERE NOT member <= 200")(lambda s, d: z.zremrange(zst(s, d), z.lex_between(None, 200)))
UNION = "SELECT member, 2.0 * score AS s FROM a UNION ALL SELECT member, score FROM b UNION ALL SELECT member, 0.5 * score FROM c"
for how in ("sum", "min", "max"):
    query(f"zunion_{how}", "", f"{PRIS} SELECT member, round({how}(s), 4) AS score FROM ({UNION}) GROUP BY member")(lambda s, d, how=how: rounded(z.zcombine(three(s, d), [2.0, 1.0, 0.5], how)))
query("zinter", "", f"{PRIS} SELECT member, round(sum(s), 4) AS score FROM ({UNION}) GROUP BY member HAVING count(*) = 3")(lambda s, d: rounded(z.zcombine(three(s, d), [2.0, 1.0, 0.5], "sum", intersect=True)))
query("zunion_with_set", "st", f", {PRI.format(n='a', p='1-URGENT')} SELECT member, round(sum(s), 4) AS score FROM (SELECT member, score AS s FROM a UNION ALL SELECT member, 3.0 FROM st WHERE key = '5-LOW') GROUP BY 1")(
    lambda s, d: rounded(z.zcombine([by_priority(s, d, "1-URGENT"), st(s, d).filter("key = '5-LOW'").select("member")], [1.0, 3.0]))
)
query("zdiff", "", f"{PRIS} SELECT * FROM a WHERE member NOT IN (SELECT member FROM b) AND member NOT IN (SELECT member FROM c)")(lambda s, d: z.zdiff(three(s, d)[0], three(s, d)[1:]))
query("zintercard", "", f"{PRIS} SELECT count(*) AS card FROM a WHERE member IN (SELECT member FROM b) AND member IN (SELECT member FROM c)")(lambda s, d: z.zintercard(three(s, d)))
query("zintercard_limit", "", f"{PRIS} SELECT least(count(*), 10) AS card FROM a WHERE member IN (SELECT member FROM b)")(lambda s, d: z.zintercard(three(s, d)[:2], 10))
query("zunionstore", "zst", "SELECT * FROM zst WHERE key <> 5 UNION ALL SELECT 5, member, sum(score) FROM zst WHERE key IN (1, 2) GROUP BY member")(
    lambda s, d: z.zstore(zst(s, d), 5, z.zcombine([zst(s, d).filter(f"key = {k}") for k in (1, 2)]))
)
query("zinterstore", "zst", "SELECT * FROM zst WHERE key <> 5")(lambda s, d: z.zstore(zst(s, d), 5, z.zcombine([zst(s, d).filter(f"key = {k}") for k in (1, 2)], intersect=True)))
query("zdiffstore", "zst", "SELECT * FROM zst WHERE key <> 5 UNION ALL SELECT 5, member, score FROM zst WHERE key = 1")(lambda s, d: z.zstore(zst(s, d), 5, z.zdiff(zst(s, d).filter("key = 1"), [zst(s, d).filter("key = 2")])))
query("zrangestore", "zst", f"SELECT * FROM zst WHERE key <> 5 UNION ALL SELECT 5, member, score FROM (SELECT member, score, {RANK} AS r FROM zst WHERE key = 7) WHERE r <= 3")(lambda s, d: z.zstore(zst(s, d), 5, z.zrange(zst(s, d).filter("key = 7"), 0, 3)))
query("zrandmember_counts", "zst", "SELECT key, least(count(*), 4) AS n FROM zst GROUP BY key")(lambda s, d: z.zrandmember(zst(s, d), 4).groupBy("key").agg(F.count("*").alias("n")))
query("zrandmember_repeats", "zst", "SELECT DISTINCT key, 9 AS n FROM zst")(lambda s, d: z.zrandmember(zst(s, d), -9).join(zst(s, d), KMS, "left_semi").groupBy("key").agg(F.count("*").alias("n")))
query("zscan", "zst", f"SELECT * FROM (SELECT key, member, score, {RANK} AS rank FROM zst) WHERE rank BETWEEN 5 AND 9 AND member % 2 = 0")(lambda s, d: z.zscan(zst(s, d), 5, 10, F.col("member") % 2 == 0))

# ---- geo ------------------------------------------------------------------------------------------------------------

X, Y = "((lon + 180.0) / 360.0 * 67108864.0)", "((lat + 85.05112878) / 170.10225756 * 67108864.0)"
BITS = "list_sum(list_transform(range(0, 26), lambda i: ((floor({y})::BIGINT >> i) & 1) * (1::BIGINT << (2 * i)) + ((floor({x})::BIGINT >> i) & 1) * (1::BIGINT << (2 * i + 1))))::BIGINT"
SCORED = f"gz AS (SELECT key, member, floor({X})::BIGINT AS cx, floor({Y})::BIGINT AS cy, {BITS.format(x=X, y=Y)}::DOUBLE AS score FROM geo)"
POINTS = SCORED + ", p AS (SELECT key, member, score, (cx / 67108864.0 + (cx + 1) / 67108864.0) * 180.0 - 180.0 AS lon, (cy / 67108864.0 + (cy + 1) / 67108864.0) * 85.05112878 - 85.05112878 AS lat FROM gz)"
HAV = "2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians({b}) - radians({y})) / 2), 2) + cos(radians({y})) * cos(radians({b})) * pow(sin((radians({a}) - radians({x})) / 2), 2)))"


def gz(s, d):
    return g.geoadd(geo(s, d))


def near(hits):
    return hits.select("key", "member", F.round("distance", 2).alias("distance"))


query("geoadd", "geo", f", {SCORED} SELECT key, member, score FROM gz")(lambda s, d: gz(s, d))
query("geopos", "geo", f", {POINTS} SELECT key, member, round(lon, 9) AS lon, round(lat, 9) AS lat FROM p")(lambda s, d: g.geopos(gz(s, d)).select("key", "member", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat")))
HASHED = BITS.format(x="(lon + 180.0) / 360.0 * 67108864.0", y="(lat + 90.0) / 180.0 * 67108864.0")
query("geohash", "geo", f", {POINTS}, h AS (SELECT key, member, {HASHED} AS b FROM p) SELECT key, member, array_to_string(list_transform(range(0, 10), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', ((b >> (52 - 5 * (i + 1))) & 31)::INTEGER + 1, 1)), '') || '0' AS hash FROM h")(lambda s, d: g.geohash(gz(s, d)))
query("geodist", "geo", f", {POINTS} SELECT 0 AS key, round({HAV.format(x='a.lon', y='a.lat', a='b.lon', b='b.lat')} / 1000, 3) AS distance FROM p a, p b WHERE a.member = 1 AND b.member = 40")(
    lambda s, d: g.geodist(gz(s, d).withColumn("key", F.lit(0)), 1, 40, "km").select("key", F.round("distance", 3).alias("distance"))
)
AT = HAV.format(x="13.4", y="52.5", a="lon", b="lat")
query("georadius", "geo", f", {POINTS} SELECT key, member, round({AT} / 1000, 2) AS distance FROM p WHERE {AT} <= 1500000")(lambda s, d: near(g.geosearch(gz(s, d), 13.4, 52.5, radius=1500, unit="km")))
query("georadius_count", "geo", f", {POINTS}, r AS (SELECT key, member, {AT} / 1000 AS x FROM p WHERE {AT} <= 6000000) SELECT key, member, round(x, 2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x, member) AS k FROM r) WHERE k <= 2")(lambda s, d: near(g.geosearch(gz(s, d), 13.4, 52.5, radius=6000, unit="km", count=2)))
BOX = f"{HAV.format(x='13.4', y='lat', a='lon', b='lat')} <= 2000000 AND {HAV.format(x='13.4', y='52.5', a='13.4', b='lat')} <= 1500000"
query("geosearch_box", "geo", f", {POINTS} SELECT key, member, round({AT} / 1000, 2) AS distance FROM p WHERE {BOX}")(lambda s, d: near(g.geosearch(gz(s, d), 13.4, 52.5, box=(4000, 3000), unit="km")))
query("geosearchstore", "geo", f", {POINTS} SELECT key, member, round(score, 2) AS score FROM p WHERE key <> 0 UNION ALL SELECT 0, member, round({AT} / 1000, 2) FROM p WHERE key = 1 AND {AT} <= 9000000")(
    lambda s, d: g.geosearchstore(gz(s, d), 0, g.geosearch(gz(s, d).filter("key = 1"), 13.4, 52.5, radius=9000, unit="km"), True).withColumn("score", F.round("score", 2))
)
query("georadiusbymember", "geo", f", {POINTS}, c AS (SELECT lon AS x, lat AS y FROM p WHERE member = 1) SELECT key, member, round({HAV.format(x='x', y='y', a='lon', b='lat')} / 1000, 2) AS distance FROM p, c WHERE {HAV.format(x='x', y='y', a='lon', b='lat')} <= 2500000")(lambda s, d: near(g.geosearch(gz(s, d), *_centre(s, d), radius=2500, unit="km")))


def _centre(s, d):
    points = gz(s, d)
    key = points.filter("member = 1").first()["key"]
    return g.centre_of(points, key, 1)


def batch(s, d):
    """A batch that names members repeatedly."""
    n = table(s, d, "lineitem")
    return n.select((F.col("l_suppkey") % 20).alias("key"), (F.col("l_partkey") % 50).alias("member"), F.col("l_quantity").cast("double").alias("score"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("long")).alias("o"))


BATCH = "SELECT l_suppkey % 20 AS key, l_partkey % 50 AS member, l_quantity::DOUBLE AS score, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity::BIGINT AS o FROM lineitem"  # equal orders have equal scores
for name, options, one in (("zadd_last_wins", {}, "arg_max(score, o)"), ("zadd_first_stays", {"nx": True}, "arg_min(score, o)"), ("zadd_incr_repeats", {"incr": True}, "sum(score)")):
    query(name, "", f"SELECT key, member, {one} AS score FROM ({BATCH}) GROUP BY 1, 2")(lambda s, d, options=options: z.zadd(batch(s, d).select("key", "member", "score").limit(0), batch(s, d), order="o", **options))
query("zadd_reply_repeats", "", f"SELECT key, count(DISTINCT member) AS reply FROM ({BATCH}) GROUP BY 1")(lambda s, d: z.zadd_reply(batch(s, d).select("key", "member", "score").limit(0), batch(s, d), order="o"))
