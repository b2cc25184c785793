"""List, string and bitmap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import bitmaps as b
from keyloom.operators import lists as x
from keyloom.operators import strings as g
from keyloom.plans.views import NOW_MS, bit, lst, millis, query, strs, table

N = "SELECT *, pos AS rank, count(*) OVER (PARTITION BY key) AS n FROM lst"

query("llen", "lst", "SELECT key, count(*) AS length FROM lst GROUP BY key")(lambda s, d: x.llen(lst(s, d)))
query("lrange", "lst", "SELECT key, pos, value, pos AS rank FROM lst WHERE pos BETWEEN 1 AND 3")(lambda s, d: x.lrange(lst(s, d), 1, 3))
query("lrange_tail", "lst", f"SELECT key, pos, value, rank FROM ({N}) WHERE rank >= n - 2")(lambda s, d: x.lrange(lst(s, d), -2, -1))
query("lrange_clamped", "lst", "SELECT key, pos, value, pos AS rank FROM lst WHERE pos = 0")(lambda s, d: x.lrange(lst(s, d), 0, -100))
query("ltrim", "lst", f"SELECT key, pos, value FROM ({N}) WHERE rank >= 1 AND rank <= n - 2")(lambda s, d: x.ltrim(lst(s, d), 1, -2))
query("lindex", "lst", "SELECT key, value FROM lst WHERE pos = 2")(lambda s, d: x.lindex(lst(s, d), 2))
query("lindex_last", "lst", f"SELECT key, value FROM ({N}) WHERE rank = n - 1")(lambda s, d: x.lindex(lst(s, d), -1))
query("lset", "lst", "SELECT key, pos, CASE WHEN pos = 1 THEN -7 ELSE value END AS value FROM lst")(lambda s, d: x.lset(lst(s, d), 1, F.lit(-7).cast("long")))
query("lpop", "lst", "SELECT key, pos, value, pos AS rank FROM lst WHERE pos < 2")(lambda s, d: x.pop(lst(s, d), 2)[0])
query("rpop", "lst", f"SELECT key, pos, value, n - 1 - rank AS rank FROM ({N}) WHERE rank >= n - 2")(lambda s, d: x.pop(lst(s, d), 2, tail=True)[0])
query("lpop_rest", "lst", "SELECT key, pos, value FROM lst WHERE pos >= 2")(lambda s, d: x.pop(lst(s, d), 2)[1])


def small(s, d):
    """Lists of few distinct values: ship-mode codes of each supplier."""
    return lst(s, d).withColumn("value", F.col("value") % 4)


SM = "sm AS (SELECT key, pos, value % 4 AS value FROM lst)"
NTH = "SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos {o}) AS nth FROM sm"
query("lrem_head", "lst", f", {SM} SELECT key, pos, value FROM ({NTH.format(o='')}) WHERE NOT (value = 2 AND nth <= 1)")(lambda s, d: x.lrem(small(s, d), 1, 2))
query("lrem_tail", "lst", f", {SM} SELECT key, pos, value FROM ({NTH.format(o='DESC')}) WHERE NOT (value = 2 AND nth <= 2)")(lambda s, d: x.lrem(small(s, d), -2, 2))
query("lrem_all", "lst", f", {SM} SELECT * FROM sm WHERE value <> 2")(lambda s, d: x.lrem(small(s, d), 0, 2))
query("lpos", "lst", f", {SM} SELECT key, min(pos) AS index, 1 AS nth FROM sm WHERE value = 3 GROUP BY key")(lambda s, d: x.lpos(small(s, d), 3))
query("lpos_rank_count", "lst", f", {SM} SELECT key, pos AS index, nth FROM ({NTH.format(o='DESC')}) WHERE value = 1 AND nth IN (2, 3)")(lambda s, d: x.lpos(small(s, d), 1, rank=-2, count=2))
query("lpos_maxlen", "lst", f", {SM} SELECT key, pos AS index, row_number() OVER (PARTITION BY key ORDER BY pos) AS nth FROM sm WHERE value = 1 AND pos < 3")(lambda s, d: x.lpos(small(s, d), 1, count=0, maxlen=3))
query("linsert", "lst", f", {SM} SELECT key, pos::DOUBLE AS pos, value FROM sm UNION ALL SELECT key, min(pos) - CASE WHEN min(pos) = 0 THEN 1 ELSE 0.5 END, 99 FROM sm WHERE value = 2 GROUP BY key")(lambda s, d: x.linsert(small(s, d), 2, F.lit(99).cast("long")))


def pushes(s, d):
    return lst(s, d).select("key").distinct().filter("key % 5 = 0").select("key", F.posexplode(F.array(*[F.lit(v).cast("long") for v in (11, 22)])).alias("o", "value"))


query("rpush", "lst", "SELECT key, pos::DOUBLE AS pos, value FROM lst UNION ALL SELECT key, max(pos) + 1.0, 11 FROM lst WHERE key % 5 = 0 GROUP BY key UNION ALL SELECT key, max(pos) + 2.0, 22 FROM lst WHERE key % 5 = 0 GROUP BY key")(lambda s, d: x.push(lst(s, d), pushes(s, d), "o"))
query("lpush", "lst", "SELECT key, pos::DOUBLE AS pos, value FROM lst UNION ALL SELECT key, -1.0, 11 FROM lst WHERE key % 5 = 0 GROUP BY key UNION ALL SELECT key, -2.0, 22 FROM lst WHERE key % 5 = 0 GROUP BY key")(lambda s, d: x.push(lst(s, d), pushes(s, d), "o", head=True))
query("rpushx", "lst", "SELECT key, pos::DOUBLE AS pos, value FROM lst")(lambda s, d: x.push(lst(s, d), pushes(s, d).withColumn("key", -F.col("key") - 1), "o", only_existing=True))
KEYS2 = "(SELECT min(key) FROM lst)"
query("lmove", "lst", f"SELECT key, pos::DOUBLE AS pos, value FROM lst WHERE NOT (key = {KEYS2} AND pos = 0) UNION ALL SELECT (SELECT max(key) FROM lst), (SELECT max(pos) + 1.0 FROM lst WHERE key = (SELECT max(key) FROM lst)), value FROM lst WHERE key = {KEYS2} AND pos = 0")(lambda s, d: _lmove(s, d))
query("lmpop", "lst", f"SELECT key, pos, value, pos AS rank FROM lst WHERE key = {KEYS2} AND pos < 2")(lambda s, d: x.lmpop(lst(s, d), [-5, lst(s, d).agg(F.min("key")).first()[0]], 2))


def _lmove(s, d):
    r = table(s, d, "lineitem").agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b")).first()
    return x.lmove(lst(s, d), r["a"], r["b"], to_tail=True)


# ---- strings --------------------------------------------------------------------------------------------------------

BYTES = "encode(coalesce(value, ''))"
query("strlen", "str", "SELECT key, octet_length(encode(value))::INTEGER AS length FROM str")(lambda s, d: g.strlen(strs(s, d)))
query("getrange", "str", "SELECT key, lower(hex(encode(value)[3:12])) AS part FROM str")(lambda s, d: strs(s, d).select("key", F.lower(F.hex(g.substring_bytes(F.col("value"), 2, 11))).alias("part")))
query("getrange_tail", "str", "SELECT key, lower(hex(encode(value)[greatest(octet_length(encode(value)) - 4, 1):octet_length(encode(value))])) AS part FROM str")(lambda s, d: strs(s, d).select("key", F.lower(F.hex(g.substring_bytes(F.col("value"), -5, -1))).alias("part")))
query("setrange", "str", "SELECT key, md5(encode(value)[1:4] || encode('XYZ') || encode(value)[8:octet_length(encode(value))]) AS h FROM str WHERE octet_length(encode(value)) >= 8")(lambda s, d: strs(s, d).filter(F.octet_length("value") >= 8).select("key", F.md5(g.overwritten(F.col("value"), 4, b"XYZ")).alias("h")))
query("get", "str", "SELECT value FROM str WHERE key = 11")(lambda s, d: g.get(strs(s, d), 11))
query("mget", "", "SELECT i AS pos, k AS key, text AS value FROM (SELECT i, [5, 999999, 5, 8][i + 1] AS k FROM range(4) r(i)) LEFT JOIN documents ON doc_id = k")(
    lambda s, d: g.mget(strs(s, d), s.range(1).select(F.posexplode(F.array(*[F.lit(v).cast("long") for v in (5, 999999, 5, 8)])).alias("pos", "key")))
)
query("getdel_rest", "str", "SELECT key, md5(value) AS h FROM str WHERE key % 6 <> 0")(lambda s, d: g.getdel(strs(s, d), strs(s, d).filter("key % 6 = 0"))[1].select("key", F.md5(F.col("value").cast("binary")).alias("h")))


def counters(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 10).cast("string").alias("value"))


CNT = "cn AS (SELECT c_custkey AS key, (c_custkey * 10)::VARCHAR AS value FROM customer)"


def increments(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 7 - 3).alias("by"), F.col("o_orderkey").alias("seq"))


query("incrby", "", f"WITH {CNT} SELECT key, (value::BIGINT + coalesce(delta, 0))::VARCHAR AS value FROM cn LEFT JOIN (SELECT o_custkey AS key, sum(o_orderkey % 7 - 3)::BIGINT AS delta FROM orders GROUP BY 1) USING (key)")(lambda s, d: g.incrby(counters(s, d), increments(s, d)))
query("incr_replies", "", "SELECT o_custkey AS key, o_orderkey AS seq, (o_orderkey % 7 - 3) AS by, sum(o_orderkey % 7 - 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS reply FROM orders")(lambda s, d: g.incr_replies(increments(s, d), "seq"))
query("incrbyfloat", "", "SELECT o_custkey AS key, count(*)::DOUBLE * 0.5 AS v FROM orders GROUP BY 1")(lambda s, d: g.incrbyfloat(counters(s, d).limit(0), increments(s, d).withColumn("by", F.lit(0.5)), "seq").select("key", F.col("value").cast("double").alias("v")))
NEWS = "SELECT c_custkey * 2 AS key, 'x' AS value FROM customer WHERE c_custkey % 3 = 0"


def news(s, d):
    return table(s, d, "customer").filter("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("key"), F.lit("x").alias("value"))


query("set", "", f"WITH {CNT}, n AS ({NEWS}) SELECT * FROM n UNION ALL SELECT * FROM cn WHERE key NOT IN (SELECT key FROM n)")(lambda s, d: g.set_(counters(s, d), news(s, d)))
query("set_xx", "", f"WITH {CNT}, n AS ({NEWS}) SELECT cn.key, coalesce(n.value, cn.value) AS value FROM cn LEFT JOIN n USING (key)")(lambda s, d: g.set_(counters(s, d), news(s, d), xx=True))
query("setnx", "", f"WITH {CNT}, n AS ({NEWS}) SELECT * FROM cn UNION ALL SELECT * FROM n WHERE key NOT IN (SELECT key FROM cn)")(lambda s, d: g.setnx(counters(s, d), news(s, d)))
query("msetnx", "", f"WITH {CNT} SELECT * FROM cn")(lambda s, d: g.msetnx(counters(s, d), news(s, d)))
query("getset", "", f"WITH {CNT}, n AS ({NEWS}) SELECT n.key, cn.value FROM n LEFT JOIN cn USING (key)")(lambda s, d: g.getset(counters(s, d), news(s, d))[0])
query("append", "", "SELECT conv_id AS key, string_agg(role || ':' || turn, '|' ORDER BY turn) || '|' AS value FROM conversations GROUP BY 1")(
    lambda s, d: g.append(s.createDataFrame([], "key long, value string"), table(s, d, "conversations").select(F.col("conv_id").alias("key"), F.concat("role", F.lit(":"), F.col("turn").cast("string"), F.lit("|")).alias("value"), "turn"), "turn")
)
EXP = f"ex AS (SELECT o_orderkey AS key, o_orderstatus AS value, CASE WHEN o_orderkey % 5 > 0 THEN epoch_us(o_orderdate) // 1000 END AS expire_at_ms FROM orders)"


def expiring(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderkey") % 5 > 0, millis("o_orderdate")).alias("expire_at_ms"))


query("getex", "", f"WITH {EXP} SELECT key, value, CASE WHEN key % 2 = 0 THEN {NOW_MS + 1000}::BIGINT ELSE expire_at_ms END AS expire_at_ms FROM ex WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW_MS}")(lambda s, d: g.getex(expiring(s, d), expiring(s, d).filter("key % 2 = 0"), NOW_MS, ttl_ms=1000)[1])
query("digest")(lambda s, d: g.digest(strs(s, d)))
query("throttle_gcra")(lambda s, d: g.throttle(table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), millis("ts").alias("now_ms")), "seq", max_burst=2, count=3, period=86400))

# ---- bitmaps --------------------------------------------------------------------------------------------------------

query("bitcount", "bit", "SELECT key, count(*) AS bits FROM bit GROUP BY key")(lambda s, d: b.bitcount(bit(s, d)))
query("bitcount_range", "bit", "SELECT key, count(*) FILTER (pos BETWEEN 10 AND 99) AS bits FROM bit GROUP BY key")(lambda s, d: b.bitcount(bit(s, d), 10, 99))
query("bitpos", "bit", "SELECT key, coalesce(min(pos) FILTER (pos >= 20), -1) AS pos FROM bit GROUP BY key")(lambda s, d: b.bitpos(bit(s, d), 1, 20))
MOD = "m AS (SELECT o_orderpriority AS key, o_custkey AS pos FROM orders GROUP BY 1, 2)"


def bits(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("pos")).distinct()


query("bitpos_zero", "", f"WITH {MOD}, k AS (SELECT DISTINCT key FROM m) SELECT key, (SELECT min(p) FROM range(1, 100000) r(p) WHERE p NOT IN (SELECT pos FROM m WHERE m.key = k.key)) AS pos FROM k")(lambda s, d: b.bitpos(bits(s, d), 0, 1))
query("getbit", "", f"WITH {MOD} SELECT key, max((pos = 100)::INTEGER) AS bit FROM m GROUP BY key")(lambda s, d: b.getbit(bits(s, d), 100))
query("setbit", "", f"WITH {MOD} SELECT * FROM m UNION SELECT '5-LOW', 0")(lambda s, d: b.setbit(bits(s, d), "5-LOW", 0, 1))
PAIR = "SELECT pos FROM m WHERE key = '{}'"
for op, body in (("and", f"{PAIR.format('1-URGENT')} INTERSECT {PAIR.format('2-HIGH')}"), ("or", f"{PAIR.format('1-URGENT')} UNION {PAIR.format('2-HIGH')}"), ("xor", "SELECT pos FROM m WHERE key IN ('1-URGENT', '2-HIGH') GROUP BY pos HAVING count(*) = 1")):
    query(f"bitop_{op}", "", f"WITH {MOD} {body}")(lambda s, d, op=op: b.bitop(bits(s, d), op.upper(), ["1-URGENT", "2-HIGH", "nosuch"]))
query("bitop_not", "", f"WITH {MOD} SELECT p AS pos FROM range(0, (SELECT (max(pos) | 7) + 1 FROM m WHERE key = '5-LOW')) r(p) WHERE p NOT IN ({PAIR.format('5-LOW')})")(lambda s, d: b.bitop(bits(s, d), "NOT", ["5-LOW"]))
query("bitcount_binary", "", "SELECT p_partkey AS key, length(replace(array_to_string(list_transform(range(1, octet_length(encode(p_brand)) + 1), lambda i: bin(('0x' || hex(encode(p_brand)[i:i]))::INTEGER)), ''), '0', '')) AS bits FROM part")(lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("key"), b.bitcount_of(F.col("p_brand")).alias("bits")))
query("bitfield_ro", "", "SELECT p_partkey AS key, ('0x' || hex(encode(p_brand)[1:2]))::BIGINT AS f FROM part")(lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("key"), b.bitfield_ro(F.col("p_brand"), "u16", 0).alias("f")))
query("bitfield")(lambda s, d: b.bitfield_all(table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")), [("INCRBY", "u8", 0, 10), ("OVERFLOW", "SAT"), ("INCRBY", "i8", "#1", 100), ("GET", "u4", 0)]).select("key", F.hex("value").alias("value"), F.array_join("replies", ",").alias("replies")))
query("bitop_xor_repeat", "", f"WITH {MOD} {PAIR.format('5-LOW')}")(lambda s, d: b.bitop(bits(s, d), "XOR", ["1-URGENT", "5-LOW", "1-URGENT"]))
query("bitop_not_bytes", "", f"WITH {MOD} SELECT p AS pos FROM range(0, 800000) r(p) WHERE p NOT IN ({PAIR.format('5-LOW')})")(lambda s, d: b.bitop(bits(s, d), "NOT", ["5-LOW"], n_bytes=100_000))
query("bitpos_none", "", f"WITH {MOD} SELECT DISTINCT key, -1 AS pos FROM m")(lambda s, d: b.bitpos(bits(s, d), 1, 1 << 40))
query("incrbyfloat_extremes", "", "SELECT p_partkey AS key, CASE WHEN p_partkey = 0 THEN '0' WHEN p_partkey % 2 = 0 THEN p_partkey || repeat('0', 25) ELSE '-0.' || rtrim(lpad(p_partkey::VARCHAR, 20, '0'), '0') END AS value FROM part")(
    lambda s, d: g.incrbyfloat(table(s, d, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey"), F.lit("e25"))).otherwise(F.concat(F.lit("-"), F.col("p_partkey"), F.lit("e-20"))).alias("value")), table(s, d, "part").select(F.col("p_partkey").alias("key"), F.lit(0.0).alias("by"), F.lit(1).alias("o")), "o")
)
query("lset_replies", "lst", "SELECT key, CASE WHEN count(*) <= 3 THEN 'ERR index out of range' ELSE 'OK' END AS reply FROM lst GROUP BY 1")(lambda s, d: x.lset_replies(lst(s, d), -4))
