"""Set and hash queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes as h
from keyloom.operators import sets as t
from keyloom.plans.views import NOW_MS, hsh, query, st

A, B, C = "1-URGENT", "2-HIGH", "3-MEDIUM"
ONE = "SELECT member FROM st WHERE key = '{}'"

query("smembers", "st", "SELECT key, member FROM st")(lambda s, d: t.smembers(st(s, d)))
query("scard", "st", "SELECT key, count(*) AS card FROM st GROUP BY key")(lambda s, d: t.scard(st(s, d)))
query("sismember", "st", f"SELECT key, member, 1 AS found FROM st WHERE key = '{A}' AND member % 5 = 0")(lambda s, d: t.smismember(st(s, d), st(s, d).filter(F.col("member") % 5 == 0).filter(f"key = '{A}'")))
ASK = "SELECT key, m AS member FROM (SELECT DISTINCT key FROM st), (VALUES (1), (7), (50), (-1)) v(m)"


def asked(s, d):
    return st(s, d).select("key").distinct().select("key", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 7, 50, -1)])).alias("member"))


query("smismember", "st", f"SELECT a.key, a.member, (st.key IS NOT NULL)::INTEGER AS found FROM ({ASK}) a LEFT JOIN st ON st.key = a.key AND st.member = a.member")(lambda s, d: t.smismember(st(s, d), asked(s, d)))
query("sinter", "st", " INTERSECT ".join(ONE.format(k) for k in (A, B, C)))(lambda s, d: t.sinter(st(s, d), [A, B, C]))
query("sunion", "st", " UNION ".join(ONE.format(k) for k in (A, B)))(lambda s, d: t.sunion(st(s, d), [A, B]))
query("sdiff", "st", " EXCEPT ".join(ONE.format(k) for k in (A, B, C)))(lambda s, d: t.sdiff(st(s, d), [A, B, C]))
query("sintercard", "st", f"SELECT count(*) AS card FROM ({ONE.format(A)} INTERSECT {ONE.format(B)})")(lambda s, d: t.sintercard(st(s, d), [A, B]))
query("sintercard_limit", "st", f"SELECT least(count(*), 25) AS card FROM ({ONE.format(A)} INTERSECT {ONE.format(B)})")(lambda s, d: t.sintercard(st(s, d), [A, B], 25))
for op, word, f in (("sinterstore", "INTERSECT", t.sinter), ("sunionstore", "UNION", t.sunion), ("sdiffstore", "EXCEPT", t.sdiff)):
    query(op, "st", f"SELECT * FROM st WHERE key <> '{C}' UNION ALL SELECT '{C}', member FROM ({ONE.format(A)} {word} {ONE.format(B)})")(lambda s, d, f=f: t.sstore(st(s, d), C, f(st(s, d), [A, B])))
query("sadd", "st", "SELECT * FROM st UNION SELECT key, member + 5 FROM st WHERE member % 9 = 0")(lambda s, d: t.sadd(st(s, d), st(s, d).filter("member % 9 = 0").select("key", (F.col("member") + 5).alias("member")))[0])
query("sadd_reply", "st", "SELECT key, count(*) FILTER (n.member NOT IN (SELECT member FROM st o WHERE o.key = n.key)) AS added FROM (SELECT DISTINCT key, member + 5 AS member FROM st WHERE member % 9 = 0) n GROUP BY key")(lambda s, d: t.sadd(st(s, d), st(s, d).filter("member % 9 = 0").select("key", (F.col("member") + 5).alias("member")))[1])
query("saddex", "st", f"SELECT key, member, CASE WHEN member % 10 = 0 THEN {NOW_MS + 60000}::BIGINT END AS expire_at_ms FROM st")(lambda s, d: t.saddex(st(s, d).withColumn("expire_at_ms", F.lit(None).cast("long")), st(s, d).filter("member % 10 = 0"), 60, NOW_MS))
query("srem", "st", "SELECT * FROM st WHERE member % 4 <> 1")(lambda s, d: t.srem(st(s, d), st(s, d).filter("member % 4 = 1")))
query("smove", "st", f"SELECT * FROM st WHERE NOT (key = '{A}' AND member = (SELECT min(member) FROM st WHERE key = '{A}')) UNION SELECT '{B}', min(member) FROM st WHERE key = '{A}'")(lambda s, d: t.smove(st(s, d), A, B, st(s, d).filter(f"key = '{A}'").agg(F.min("member").alias("m")).first()["m"]))
query("spop_counts", "st", "SELECT key, 5 AS popped, count(*) - 5 AS left_over FROM st GROUP BY key")(lambda s, d: _spop(s, d))
query("srandmember_repeats", "st", "SELECT DISTINCT key, 12 AS n FROM st")(lambda s, d: t.srandmember(st(s, d), -12).join(st(s, d), ["key", "member"], "left_semi").groupBy("key").agg(F.count("*").alias("n")))
query("sscan", "st", "SELECT key, member, rank FROM (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS rank FROM st) WHERE rank BETWEEN 20 AND 49 AND member % 2 = 1")(lambda s, d: t.sscan(st(s, d), 20, 30, F.col("member") % 2 == 1))


def _spop(s, d):
    popped, rest = t.spop(st(s, d), 5)
    return t.scard(popped).withColumnRenamed("card", "popped").join(t.scard(rest).withColumnRenamed("card", "left_over"), "key")


# ---- hashes ---------------------------------------------------------------------------------------------------------

query("hget", "hsh", "SELECT key, value FROM hsh WHERE field = 'status'")(lambda s, d: h.hget(hsh(s, d), "status"))
query("hmget", "hsh", "SELECT key, max(value) FILTER (field = 'status') AS status, max(value) FILTER (field = 'cust') AS cust, NULL::VARCHAR AS nosuch FROM hsh GROUP BY key")(lambda s, d: h.hmget(hsh(s, d), ["status", "cust", "nosuch"]))
query("hlen", "hsh", "SELECT key, count(*) AS length FROM hsh GROUP BY key")(lambda s, d: h.hlen(hsh(s, d)))
query("hgetall", "hsh", "SELECT key, string_agg(field || '=' || value, ';' ORDER BY field) AS all FROM hsh GROUP BY key")(lambda s, d: h.hgetall(hsh(s, d)).select("key", F.array_join(F.transform(F.map_entries("all"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("all")))
query("hkeys", "hsh", "SELECT key, string_agg(field, ',' ORDER BY field) AS fields FROM hsh GROUP BY key")(lambda s, d: h.hkeys(hsh(s, d)).select("key", F.array_join("fields", ",").alias("fields")))
query("hvals", "hsh", "SELECT key, string_agg(value, ',' ORDER BY field) AS \"values\" FROM hsh GROUP BY key")(lambda s, d: h.hvals(hsh(s, d)).select("key", F.array_join("values", ",").alias("values")))
query("hexists", "hsh", "SELECT key, max((field = 'cust')::INTEGER) AS found FROM hsh GROUP BY key")(lambda s, d: h.hexists(hsh(s, d), "cust"))
query("hstrlen", "hsh", "SELECT key, octet_length(encode(value))::INTEGER AS length FROM hsh WHERE field = 'priority'")(lambda s, d: h.hstrlen(hsh(s, d), "priority"))
query("hdel", "hsh", "SELECT * FROM hsh WHERE field NOT IN ('cust', 'status')")(lambda s, d: h.hdel(hsh(s, d), ["cust", "status"])[0])
query("hdel_reply", "hsh", "SELECT key, count(*) FILTER (field IN ('cust', 'status')) AS removed FROM hsh GROUP BY key")(lambda s, d: h.hdel(hsh(s, d), ["cust", "status"])[1])


def fresh(s, d):
    k = hsh(s, d).select("key").distinct()
    return k.filter("key % 4 = 0").select("key", F.lit("cust").alias("field"), F.lit("new").alias("value")).unionByName(k.filter("key % 8 = 0").select("key", F.lit("note").alias("field"), F.lit("n").alias("value")))


NEW = "SELECT o_orderkey AS key, 'cust' AS field, 'new' AS value FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'note', 'n' FROM orders WHERE o_orderkey % 8 = 0"
query("hset", "hsh", f"SELECT * FROM hsh o WHERE NOT EXISTS (FROM ({NEW}) n WHERE n.key = o.key AND n.field = o.field) UNION ALL {NEW}")(lambda s, d: h.hset(hsh(s, d), fresh(s, d))[0])
query("hset_reply", "hsh", f"SELECT n.key, count(*) FILTER (o.key IS NULL) AS created FROM ({NEW}) n LEFT JOIN hsh o ON n.key = o.key AND n.field = o.field GROUP BY 1")(lambda s, d: h.hset(hsh(s, d), fresh(s, d))[1])
query("hsetnx", "hsh", f"SELECT * FROM hsh UNION ALL SELECT * FROM ({NEW}) n WHERE NOT EXISTS (FROM hsh o WHERE n.key = o.key AND n.field = o.field)")(lambda s, d: h.hsetnx(hsh(s, d), fresh(s, d)))
CUST = "hsh WHERE field = 'cust'"
query("hincrby", "hsh", "SELECT key, field, CASE WHEN field = 'cust' THEN (value::BIGINT + 17)::VARCHAR ELSE value END AS value FROM hsh")(lambda s, d: h.hincrby(hsh(s, d), hsh(s, d).filter("field = 'cust'").select("key", "field", F.lit(17).alias("by"))))
query("hincrbyfloat", "hsh", "SELECT key, field, CASE WHEN field = 'cust' THEN value || '.5' ELSE value END AS value FROM hsh")(lambda s, d: h.hincrbyfloat(hsh(s, d), hsh(s, d).filter("field = 'cust'").select("key", "field", F.lit(0.5).alias("by"))))
TTL = f"CASE WHEN key % 3 = 0 THEN {NOW_MS} + key * 100 WHEN key % 3 = 1 THEN {NOW_MS} - 5 END"
HX = f"hx AS (SELECT key, field, value, ({TTL})::BIGINT AS expire_at_ms FROM hsh)"
LIVE = f"SELECT * FROM hx WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW_MS}"


def hx(s, d):
    k = F.col("key")
    return hsh(s, d).withColumn("expire_at_ms", F.when(k % 3 == 0, NOW_MS + k * 100).when(k % 3 == 1, F.lit(NOW_MS - 5)))


def fields(s, d):
    return hsh(s, d).select("key").distinct().withColumn("field", F.lit("cust"))


query("hlen_live", "hsh", f", {HX} SELECT key, count(*) AS length FROM ({LIVE}) GROUP BY key")(lambda s, d: h.hlen(hx(s, d), NOW_MS))
query("httl", "hsh", f", {HX} SELECT o_orderkey AS key, 'cust' AS field, CASE WHEN l.key IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE (expire_at_ms - {NOW_MS}) // 1000 END::BIGINT AS ttl FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN ({LIVE}) l ON l.key = o_orderkey AND field = 'cust'")(lambda s, d: h.httl(hx(s, d), fields(s, d), NOW_MS))
query("hpexpiretime", "hsh", f", {HX} SELECT o_orderkey AS key, 'cust' AS field, CASE WHEN l.key IS NULL THEN -2 ELSE coalesce(expire_at_ms, -1) END::BIGINT AS at_ms FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN ({LIVE}) l ON l.key = o_orderkey AND field = 'cust'")(lambda s, d: h.hpexpiretime(hx(s, d), fields(s, d), NOW_MS))
query("hexpire_gt", "hsh", f", {HX} SELECT o_orderkey AS key, 'cust' AS field, CASE WHEN l.key IS NULL THEN -2 WHEN {NOW_MS + 300000} > coalesce(expire_at_ms, 9223372036854775807) THEN 1 ELSE 0 END AS reply, CASE WHEN l.key IS NULL THEN NULL WHEN {NOW_MS + 300000} > coalesce(expire_at_ms, 9223372036854775807) THEN {NOW_MS + 300000} ELSE expire_at_ms END::BIGINT AS expire_at_ms FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN ({LIVE}) l ON l.key = o_orderkey AND field = 'cust'")(lambda s, d: h.hexpire(hx(s, d), fields(s, d), 300, NOW_MS, "GT"))
query("hsetex", "hsh", f", {HX}, n AS ({NEW}) SELECT key, field, value, expire_at_ms FROM ({LIVE}) o WHERE NOT EXISTS (FROM n WHERE n.key = o.key AND n.field = o.field) UNION ALL SELECT key, field, value, {NOW_MS + 5000} FROM n")(lambda s, d: h.hsetex(hx(s, d), fresh(s, d), 5, NOW_MS))
query("hsetex_fnx", "hsh", f", {HX}, n AS ({NEW}), ok AS (SELECT n.key FROM n LEFT JOIN ({LIVE}) l USING (key, field) GROUP BY n.key HAVING count(l.value) = 0) SELECT key, field, value, expire_at_ms FROM ({LIVE}) UNION ALL SELECT key, field, value, {NOW_MS + 5000} FROM n WHERE key IN (SELECT key FROM ok)")(lambda s, d: h.hsetex(hx(s, d), fresh(s, d), 5, NOW_MS, guard="FNX"))
query("hgetex_persist", "hsh", f", {HX} SELECT key, field, value, CASE WHEN field <> 'cust' THEN expire_at_ms END AS expire_at_ms FROM ({LIVE})")(lambda s, d: h.hgetex(hx(s, d), fields(s, d), NOW_MS, persist=True)[1])
query("hrandfield_counts", "hsh", "SELECT key, least(count(*), 2) AS n FROM hsh GROUP BY key")(lambda s, d: h.hrandfield(hsh(s, d), 2).groupBy("key").agg(F.count("*").alias("n")))
query("hscan", "hsh", "SELECT * FROM (SELECT key, field, value, row_number() OVER (PARTITION BY key ORDER BY field) - 1 AS rank FROM hsh) WHERE rank BETWEEN 1 AND 2 AND field LIKE 's%'")(lambda s, d: h.hscan(hsh(s, d), 1, 2, F.col("field").startswith("s")))
