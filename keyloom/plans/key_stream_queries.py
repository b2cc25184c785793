"""Key, SORT, stream, publish/subscribe and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.kernels import live
from keyloom.operators import entries as e
from keyloom.operators import keys as k
from keyloom.operators import pubsub as p
from keyloom.operators import reports as r
from keyloom.plans.views import NOW_MS, ksp, query, table, xen, zst

COLS = ["db", "key", "type", "expire_at_ms", "sticky", "touched", "bytes"]
ALIVE = f"(expire_at_ms IS NULL OR expire_at_ms > {NOW_MS})"


def even(s, d):
    return ksp(s, d).filter("bytes % 2 = 0").select("key")


query("live_keys", "ksp", f"SELECT * FROM ksp WHERE {ALIVE} OR sticky")(lambda s, d: live(ksp(s, d), NOW_MS))
query("del", "ksp", "SELECT * FROM ksp WHERE bytes % 2 <> 0")(lambda s, d: k.delete(ksp(s, d), even(s, d))[0].select(*COLS))
query("del_reply", "ksp", "SELECT count(*) AS removed FROM ksp WHERE bytes % 2 = 0")(lambda s, d: k.delete(ksp(s, d), even(s, d))[1])
query("exists", "ksp", "SELECT 2 * count(*) AS found FROM ksp WHERE bytes % 2 = 0")(lambda s, d: k.exists(ksp(s, d), even(s, d).unionAll(even(s, d)).unionAll(even(s, d).select(F.lit("none").alias("key")))))
query("touch", "ksp", "SELECT db, key, type, expire_at_ms, sticky, touched OR bytes % 2 = 0 AS touched, bytes FROM ksp")(lambda s, d: k.touch(ksp(s, d), even(s, d)).select(*COLS))
query("stick", "ksp", "SELECT db, key, type, expire_at_ms, sticky OR bytes % 2 = 0 AS sticky, touched, bytes FROM ksp")(lambda s, d: k.stick(ksp(s, d), even(s, d)).select(*COLS))
query("delex", "", "SELECT doc_id AS key, lang AS value FROM documents WHERE NOT (doc_id = 10 AND lang = (SELECT lang FROM documents WHERE doc_id = 10))")(lambda s, d: k.delex(table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("value")), 10, table(s, d, "documents").filter("doc_id = 10").first()["lang"]))
AT = NOW_MS + 3_600_000
CAP = 268_435_455_000
for name, opts, cond in (("expire", (), "TRUE"), ("expire_nx", ("NX",), "expire_at_ms IS NULL"), ("expire_gt", ("GT",), f"{AT} > coalesce(expire_at_ms, 9223372036854775807)"), ("expire_lt_xx", ("LT", "XX"), f"({AT} < coalesce(expire_at_ms, 9223372036854775807) OR expire_at_ms IS NOT NULL)")):
    query(name, "ksp", f", n AS (SELECT db, key, type, CASE WHEN {cond} THEN {AT} ELSE expire_at_ms END::BIGINT AS expire_at_ms, sticky, touched, bytes FROM ksp) SELECT * FROM n WHERE {ALIVE} OR sticky")(lambda s, d, opts=opts: k.expire(ksp(s, d), AT, NOW_MS, opts))
query("persist", "ksp", "SELECT db, key, type, CASE WHEN bytes % 2 <> 0 THEN expire_at_ms END AS expire_at_ms, sticky, touched, bytes FROM ksp")(lambda s, d: k.persist(ksp(s, d), even(s, d)).select(*COLS))
query("ttl", "ksp", f"SELECT key, coalesce(floor((expire_at_ms - {NOW_MS} + 500) / 1000), -1)::BIGINT AS ttl FROM ksp WHERE {ALIVE} OR sticky")(lambda s, d: k.ttl(ksp(s, d), NOW_MS))
query("pttl", "ksp", f"SELECT key, coalesce(expire_at_ms - {NOW_MS}, -1)::BIGINT AS pttl FROM ksp WHERE {ALIVE} OR sticky")(lambda s, d: k.pttl(ksp(s, d), NOW_MS))
query("expiretime", "ksp", "SELECT key, coalesce((expire_at_ms + 500) // 1000, -1)::BIGINT AS at_s FROM ksp")(lambda s, d: k.expiretime(ksp(s, d)))
query("pexpiretime", "ksp", "SELECT key, coalesce(expire_at_ms, -1)::BIGINT AS at_ms FROM ksp")(lambda s, d: k.pexpiretime(ksp(s, d)))
query("type", "ksp", "SELECT k AS key, coalesce(type, 'none') AS type FROM (VALUES ('o:1'), ('o:2'), ('zzz')) v(k) LEFT JOIN ksp ON ksp.key = k")(lambda s, d: k.type_of(ksp(s, d), s.createDataFrame([("o:1",), ("o:2",), ("zzz",)], "key string")))
query("keys_glob", "ksp", "SELECT * FROM ksp WHERE regexp_matches(key, '^o:1.[0-4].*$')")(lambda s, d: k.matching(ksp(s, d), "o:1?[0-4]*"))
query("keys_prefix", "ksp", "SELECT * FROM ksp WHERE key LIKE 'o:12%'")(lambda s, d: k.matching(ksp(s, d), "o:12*"))
query("move", "ksp", "SELECT CASE WHEN key = 'o:4' AND db = 0 THEN 2 ELSE db END AS db, key, type, expire_at_ms, sticky, touched, bytes FROM ksp")(lambda s, d: k.move(ksp(s, d), "o:4", 0, 2).select(*COLS))
for name, only in (("rename", False), ("renamenx", True)):
    body = "SELECT * FROM zst WHERE key NOT IN (1, 2) UNION ALL SELECT 2, member, score FROM zst WHERE key = 1" if not only else "SELECT * FROM zst"
    query(name, "zst", body)(lambda s, d, only=only: k.rename(zst(s, d), 1, 2, only_free=only))
query("copy_replace", "zst", "SELECT * FROM zst WHERE key <> 2 UNION ALL SELECT 2, member, score FROM zst WHERE key = 1")(lambda s, d: k.copy(zst(s, d), 1, 2, replace=True))
query("copy", "zst", "SELECT * FROM zst UNION ALL SELECT 77, member, score FROM zst WHERE key = 1")(lambda s, d: k.copy(zst(s, d), 1, 77))
query("scan_filters", "ksp", "SELECT count(*) AS n FROM ksp WHERE type = 'hash' AND expire_at_ms IS NOT NULL AND bytes >= 50 AND key LIKE 'o:%5%'")(lambda s, d: k.scan(ksp(s, d), None, 1_000_000, match="o:*5*", type_="hash", attr="v", min_bytes=50).agg(F.count("*").alias("n")))
query("scan_pages", "ksp", "SELECT 100 AS keys, 0 AS twice")(lambda s, d: _two_pages(s, d))
query("randomkey", "ksp", "SELECT 1 AS found")(lambda s, d: k.randomkey(ksp(s, d)).join(ksp(s, d), "key", "left_semi").agg(F.count("*").cast("int").alias("found")))
query("rm_rest", "ksp", "SELECT count(*) - 25 AS n FROM ksp")(lambda s, d: k.rm(ksp(s, d), count=25, match="o:1*")[1].agg(F.count("*").alias("n")))


def _two_pages(s, d):
    one = k.scan(ksp(s, d), None, 50)
    last = one.agg(F.max("cursor").alias("c")).first()["c"]
    both = one.unionByName(k.scan(ksp(s, d), last, 50))
    return both.agg(F.count("*").cast("int").alias("keys"), (F.count("*") - F.count_distinct("key")).cast("int").alias("twice"))


def members(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("value")).distinct()


MEM = "WITH m AS (SELECT DISTINCT o_orderpriority AS key, o_custkey AS value FROM orders)"
query("sort_numeric", "", f"{MEM} SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value, value::VARCHAR) - 1 AS rank FROM m")(lambda s, d: k.sort(members(s, d)))
query("sort_alpha_desc_limit", "", f"{MEM} SELECT * FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value::VARCHAR DESC) - 1 AS rank FROM m) WHERE rank BETWEEN 5 AND 14")(lambda s, d: k.sort(members(s, d), alpha=True, descending=True, offset=5, count=10))
query("sort_by_get", "", f"{MEM} SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY c_acctbal, value::VARCHAR) - 1 AS rank, c_name AS got FROM m JOIN customer ON c_custkey = value")(
    lambda s, d: k.sort(members(s, d), by=table(s, d, "customer").select(F.col("c_custkey").alias("value"), F.col("c_acctbal").alias("weight")), get=table(s, d, "customer").select(F.col("c_custkey").alias("value"), F.col("c_name").alias("got")))
)

# ---- streams --------------------------------------------------------------------------------------------------------

XC = ["key", "id_ms", "id_seq", "event_id", "user_id", "value"]
LO, HI = 1_704_100_000_000, 1_705_000_000_000
query("xadd_ids", "xen", "SELECT * FROM xen")(lambda s, d: e.auto_ids(xen(s, d).drop("id_seq"), "event_id"))
query("xlen", "xen", "SELECT key, count(*) AS length FROM xen GROUP BY key")(lambda s, d: e.xlen(xen(s, d)))


def mid(s, d):
    """A bound inside the data, read from it at plan time."""
    row = table(s, d, "events").agg(F.floor(F.unix_micros(F.min("ts").cast("timestamp")) / 1000).alias("a"), F.floor(F.unix_micros(F.max("ts").cast("timestamp")) / 1000).alias("b")).first()
    return row["a"] + (row["b"] - row["a"]) // 4, row["a"] + (row["b"] - row["a"]) // 2


MID = ", b AS (SELECT a + (b - a) // 4 AS lo, a + (b - a) // 2 AS hi FROM (SELECT epoch_us(min(ts)) // 1000 AS a, epoch_us(max(ts)) // 1000 AS b FROM events))"
query("xrange", "xen", f"{MID} SELECT xen.* FROM xen, b WHERE id_ms BETWEEN lo AND hi")(lambda s, d: e.xrange(xen(s, d), e.at_or_after(mid(s, d)[0]), e.at_or_before(mid(s, d)[1])))
query("xrevrange_count", "xen", f"{MID} SELECT key, id_ms, id_seq, event_id, user_id, value FROM (SELECT xen.*, row_number() OVER (PARTITION BY key ORDER BY id_ms DESC, id_seq DESC) AS r FROM xen, b WHERE id_ms <= hi) WHERE r <= 5")(lambda s, d: e.xrange(xen(s, d), None, e.at_or_before(mid(s, d)[1]), 5, reverse=True))
query("xdel_len", "xen", "SELECT key, count(*) FILTER (event_id % 3 > 0) AS length FROM xen GROUP BY key")(lambda s, d: e.xlen(e.xdel(xen(s, d), xen(s, d).filter("event_id % 3 = 0"))))
R = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM xen"
query("xtrim_maxlen", "xen", f"SELECT key, id_ms, id_seq, event_id, user_id, value FROM ({R}) WHERE r >= n - 70")(lambda s, d: e.xtrim_maxlen(xen(s, d), 70))
query("xtrim_maxlen_approx", "xen", f"SELECT key, id_ms, id_seq, event_id, user_id, value FROM ({R}) WHERE r >= greatest(n - 70, 0) // 100 * 100")(lambda s, d: e.xtrim_maxlen(xen(s, d), 70, approximate=True))
query("xtrim_minid", "xen", f"{MID} SELECT xen.* FROM xen, b WHERE id_ms >= lo")(lambda s, d: e.xtrim_minid(xen(s, d), mid(s, d)[0]))
query("xread_after", "xen", f"{MID} SELECT key, id_ms, id_seq, event_id, user_id, value FROM (SELECT xen.*, row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) AS r FROM xen, b WHERE id_ms > lo) WHERE r <= 7")(lambda s, d: e.xread(xen(s, d), _last(s, d), 7))
query("xadd_rejects", "xen", "SELECT count(*) AS rejected FROM (SELECT event_id, id_ms, max(id_ms) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM xen) WHERE id_ms <= top")(lambda s, d: _rejects(s, d))


def _rejects(s, d):
    new = xen(s, d).withColumn("id_seq", F.lit(0).cast("long"))
    return e.xadd(xen(s, d).limit(0), new, "event_id")[1].agg(F.count("*").alias("rejected"))


def _last(s, d):
    lo = mid(s, d)[0]
    return xen(s, d).select("key").distinct().select("key", F.lit(lo).cast("long").alias("last_ms"), F.lit(2**62).cast("long").alias("last_seq"))


def pel(s, d):
    """Entries delivered to consumers by user, a minute before the clock, by a count that depends on the event."""
    x = xen(s, d).filter("event_id % 2 = 0")
    return x.select("key", F.lit("g").alias("grp"), "id_ms", "id_seq", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"), (F.lit(NOW_MS) - F.col("event_id") % 100 * 1000).cast("long").alias("delivery_ms"), (F.col("event_id") % 4 + 1).cast("long").alias("delivery_count"))


PEL = f", pel AS (SELECT key, 'g' AS grp, id_ms, id_seq, 'c' || (user_id % 3) AS consumer, {NOW_MS} - event_id % 100 * 1000 AS delivery_ms, event_id % 4 + 1 AS delivery_count FROM xen WHERE event_id % 2 = 0)"
query("xpending_summary", "xen", f"{PEL} SELECT key, consumer, count(*) AS pending, min(id_ms) AS first_ms, max(id_ms) AS last_ms FROM pel GROUP BY 1, 2")(lambda s, d: e.xpending_summary(pel(s, d)).select("key", "consumer", "pending", F.col("first.id_ms").alias("first_ms"), F.col("last.id_ms").alias("last_ms")))
query("xpending_idle", "xen", f"{PEL} SELECT key, grp, id_ms, id_seq, consumer, {NOW_MS} - delivery_ms AS idle_ms, delivery_count FROM pel WHERE {NOW_MS} - delivery_ms >= 50000 AND consumer = 'c1'")(lambda s, d: e.xpending(pel(s, d), NOW_MS, min_idle=50_000, consumer="c1").drop("delivery_ms"))
query("xack", "xen", f"{PEL} SELECT * FROM pel WHERE id_ms % 5 <> 0")(lambda s, d: e.xack(pel(s, d), pel(s, d).filter("id_ms % 5 = 0")))
query("xclaim", "xen", f"{PEL} SELECT key, grp, id_ms, id_seq, CASE WHEN id_ms % 5 = 0 AND {NOW_MS} - delivery_ms >= 20000 THEN 'new' ELSE consumer END AS consumer, CASE WHEN id_ms % 5 = 0 AND {NOW_MS} - delivery_ms >= 20000 THEN {NOW_MS} ELSE delivery_ms END AS delivery_ms, CASE WHEN id_ms % 5 = 0 AND {NOW_MS} - delivery_ms >= 20000 THEN delivery_count + 1 ELSE delivery_count END AS delivery_count FROM pel")(lambda s, d: e.xclaim(pel(s, d), pel(s, d).filter("id_ms % 5 = 0"), "new", NOW_MS, 20_000))
query("xautoclaim", "xen", f"{PEL} SELECT key, id_ms, id_seq, 'new' AS consumer, delivery_count + 1 AS delivery_count FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) AS r FROM pel WHERE {NOW_MS} - delivery_ms >= 60000) WHERE r <= 10")(lambda s, d: e.xautoclaim(xen(s, d), pel(s, d), "g", "new", NOW_MS, 60_000, F.lit(True), 10)[0].select("key", "id_ms", "id_seq", "consumer", "delivery_count"))
query("xreadgroup", "xen", "SELECT key, id_ms, id_seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) AS r FROM xen) WHERE r <= 4")(lambda s, d: e.xreadgroup(xen(s, d), _groups(s, d), pel(s, d).limit(0), "g", "c9", NOW_MS, 4)[2].select("key", "id_ms", "id_seq"))
query("xinfo_lag", "xen", f"{MID} SELECT key, 'g' AS grp, count(*) FILTER (id_ms > lo) AS lag FROM xen, b GROUP BY key")(lambda s, d: e.xinfo_groups(xen(s, d), _last(s, d).withColumn("grp", F.lit("g")), pel(s, d)).select("key", "grp", "lag"))
query("xinfo_stream", "xen", "SELECT key, count(*) AS length, count(*) AS entries_added, max(id_ms) AS last_ms FROM xen GROUP BY key")(lambda s, d: e.xinfo_stream(xen(s, d)).select("key", "length", "entries_added", F.col("last_id.id_ms").alias("last_ms")))
query("xinfo_consumers", "xen", f"{PEL} SELECT key, consumer, count(*) AS pending, {NOW_MS} - max(delivery_ms) AS idle_ms FROM pel GROUP BY 1, 2")(lambda s, d: e.xinfo_consumers(pel(s, d), NOW_MS).drop("grp"))


def _groups(s, d):
    return xen(s, d).select("key").distinct().select("key", F.lit("g").alias("grp"), F.lit(0).cast("long").alias("last_ms"), F.lit(0).cast("long").alias("last_seq"))


# ---- publish and subscribe, reports ---------------------------------------------------------------------------------


def messages(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("seq"), F.concat("event_type", F.lit("."), (F.col("user_id") % 5).cast("string")).alias("channel"), F.col("props").alias("message"))


def subs(s, d):
    c = table(s, d, "customer").filter("c_custkey <= 20")
    return c.select(F.col("c_custkey").alias("conn"), F.concat(F.lit("click."), (F.col("c_custkey") % 5).cast("string")).alias("channel"))


PS = "WITH msg AS (SELECT event_id AS seq, event_type || '.' || (user_id % 5) AS channel, props AS message FROM events), sub AS (SELECT c_custkey AS conn, 'click.' || (c_custkey % 5) AS channel FROM customer WHERE c_custkey <= 20)"
GLOBS = [("p1", "c*"), ("p2", "*.[12]"), ("p3", "?iew.0")]
TESTS = "(VALUES ('p1', 'c*', '^c.*$'), ('p2', '*.[12]', '^.*[.][12]$'), ('p3', '?iew.0', '^.iew[.]0$')) v(conn, pattern, re)"
query("pubsub_fanout", "", f"{PS} SELECT seq, conn, channel, message FROM msg JOIN sub USING (channel)")(lambda s, d: p.fanout(messages(s, d), subs(s, d)))
query("psubscribe_match", "", f"{PS} SELECT seq, conn, pattern, channel, message FROM msg JOIN {TESTS} ON regexp_matches(channel, re)")(lambda s, d: p.pattern_fanout(messages(s, d), GLOBS))
query("publish_replies", "", f"{PS} SELECT seq, ((SELECT count(*) FROM sub WHERE sub.channel = msg.channel) + (SELECT count(*) FROM {TESTS} WHERE regexp_matches(msg.channel, re)))::BIGINT AS receivers FROM msg")(lambda s, d: p.publish_replies(messages(s, d), subs(s, d), GLOBS))
query("pubsub_numsub", "", f"{PS} SELECT channel, count(*) AS subscribers FROM sub GROUP BY 1")(lambda s, d: p.numsub(subs(s, d), subs(s, d).select("channel").distinct()))
query("pubsub_channels", "", f"{PS} SELECT DISTINCT channel FROM sub WHERE channel LIKE 'click.%'")(lambda s, d: p.channels(subs(s, d), "click.*"))
query("dbsize", "ksp", "SELECT count(*) AS keys FROM ksp")(lambda s, d: r.dbsize(ksp(s, d)))
query("info_keyspace", "ksp", "SELECT db, count(*) AS keys, count(expire_at_ms) AS expires FROM ksp GROUP BY db")(lambda s, d: r.keyspace(ksp(s, d)))
query("type_counts", "ksp", "SELECT type, count(*) AS keys FROM ksp GROUP BY type")(lambda s, d: r.type_counts(ksp(s, d)))
query("flushdb", "ksp", "SELECT * FROM ksp WHERE db <> 1")(lambda s, d: r.flushdb(ksp(s, d), 1))
query("flushall", "ksp", "SELECT * FROM ksp LIMIT 0")(lambda s, d: r.flushall(ksp(s, d)))
query("memory_usage_model", "", "SELECT c_custkey AS key, (CASE WHEN length(c_custkey::VARCHAR) <= 15 THEN 16 ELSE 16 + length(c_custkey::VARCHAR) END + CASE WHEN length(c_name) <= 15 THEN 16 ELSE 16 + length(c_name) END)::BIGINT AS bytes FROM customer")(lambda s, d: r.memory_usage(table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))))
query("debug_populate", "", "SELECT 'k:' || i AS key, rpad('value:' || i, 20, 'x') AS value FROM range(500) t(i)")(lambda s, d: r.populate(s, 500, "k", 20))
query("debug_uniq_strs", "", "SELECT event_type AS type, count(*) AS total, count(DISTINCT props) AS unique, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")(lambda s, d: r.unique_strings(table(s, d, "events").select(F.col("event_type").alias("type"), F.col("props").alias("text")), exact=True).select("type", "total", "unique", "bytes"))
query("command_stats", "", "SELECT event_type AS name, count(*) AS calls, sum(event_id) AS micros FROM events GROUP BY 1")(lambda s, d: r.command_stats(table(s, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("micros"))).drop("micros_per_call"))
query("slowlog", "", "SELECT event_id AS seq, event_id * 7 % 20000 AS micros FROM events WHERE event_id * 7 % 20000 >= 10000 ORDER BY event_id DESC LIMIT 20")(lambda s, d: r.slowlog(table(s, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 20000).alias("micros"))))


def shared_keys(s, d):
    """A key table in which databases hold keys of the same names."""
    o = table(s, d, "orders")
    return o.select((F.col("o_orderkey") % 4).cast("int").alias("db"), F.concat(F.lit("k:"), F.floor(F.col("o_orderkey") / 8).cast("string")).alias("key"), F.lit("string").alias("type"), F.lit(None).cast("long").alias("expire_at_ms")).distinct()


SHARED = "SELECT DISTINCT o_orderkey % 4 AS db, 'k:' || (o_orderkey // 8) AS key FROM orders"


def _scanned(s, d):
    """Two pages: together they are the table."""
    one = k.scan(shared_keys(s, d), None, 101)
    last = one.agg(F.max("cursor").alias("c")).first()["c"]
    return one.unionByName(k.scan(shared_keys(s, d), last, 100_000_000)).select("db", "key")


query("scan_dbs", "", SHARED)(lambda s, d: _scanned(s, d))
query("rm_dbs", "", f"SELECT count(*) - 33 AS n FROM ({SHARED})")(lambda s, d: k.rm(shared_keys(s, d), count=33)[1].agg(F.count("*").alias("n")))
query("del_dbs", "", f"SELECT db, key FROM ({SHARED}) WHERE db <> 1")(lambda s, d: k.delete(shared_keys(s, d), shared_keys(s, d).filter("db = 1").select("db", "key"))[0].select("db", "key"))


def _trimmed(s, d):
    """Every entry trimmed away, then added again: all are refused, and the counts stand."""
    x, meta = xen(s, d), e.stream_meta(xen(s, d))
    left, after, refused = e.xadd_meta(meta, e.xtrim_maxlen(x, 0), x, "event_id")
    info = e.xinfo_stream(left, after).select("key", "length", "entries_added")
    return info.join(refused.groupBy("key").agg(F.count("*").alias("refused")), "key")


query("xadd_after_trim", "xen", "SELECT key, 0 AS length, count(*) AS entries_added, count(*) AS refused FROM xen GROUP BY 1")(lambda s, d: _trimmed(s, d))
query("xsetid", "xen", "SELECT key, CASE WHEN key = 'view' THEN 9000000000000 ELSE max(id_ms) END AS last_ms, CASE WHEN key = 'view' THEN 7 ELSE count(*) END AS entries_added FROM xen GROUP BY 1")(lambda s, d: e.xsetid(e.stream_meta(xen(s, d)), xen(s, d), "view", 9_000_000_000_000, 5, entries_added=7).select("key", F.col("last_id.id_ms").alias("last_ms"), "entries_added"))
