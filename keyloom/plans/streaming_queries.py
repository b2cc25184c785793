"""Streaming queries, each a bounded run over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import pubsub as p
from keyloom.plans.views import millis, query
from keyloom.plans.key_stream_queries import PS, subs
from keyloom.streaming import stateful as st
from keyloom.streaming.runs import drained, source


def events(s, d):
    return source(s, d, "events").select("event_id", "event_type", "user_id", "value", millis("ts").alias("ms"))


ACCEPT = "SELECT event_type AS key, event_id AS seq, epoch_us(ts) // 1000 AS id_ms, coalesce(epoch_us(ts) // 1000 > max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS accepted FROM events"
query("stream_xadd", "", ACCEPT)(lambda s, d: drained(st.validated_entries(events(s, d).select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("ms").alias("id_ms"), F.lit(0).cast("long").alias("id_seq")))).drop("id_seq"))
query("stream_throttle")(lambda s, d: drained(st.throttled(events(s, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ms").alias("now_ms")), max_burst=2, count=3, period=86400)))
KIND = "CASE WHEN event_id % 3 = 0 THEN 'BLPOP' ELSE 'RPUSH' END"
query("stream_blpop", "", f"WITH e AS (SELECT event_type AS queue, event_id, row_number() OVER (PARTITION BY event_type, event_id % 3 = 0 ORDER BY event_id) AS n, event_id % 3 = 0 AS pop FROM events) SELECT a.queue, a.event_id::VARCHAR AS conn, b.event_id::VARCHAR AS value FROM e a JOIN e b ON a.pop AND NOT b.pop AND a.queue = b.queue AND a.n = b.n")(
    lambda s, d: drained(st.blocking_queue(events(s, d).select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "BLPOP").otherwise("RPUSH").alias("op"), F.col("event_id").cast("string").alias("conn"), F.col("event_id").cast("string").alias("value"), F.col("ms").alias("now_ms"), F.lit(0).cast("long").alias("deadline_ms")), timers=False))
)
query("stream_bzpopmin")(lambda s, d: drained(st.blocking_scores(events(s, d).select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "BZPOPMIN").otherwise("ZADD").alias("op"), F.col("event_id").cast("string").alias("conn"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"), F.col("ms").alias("now_ms"), F.lit(0).cast("long").alias("deadline_ms")), timers=False)))
query("stream_groups", "", "SELECT event_type AS key, count(*) AS delivered FROM events WHERE event_id % 10 < 5 GROUP BY 1")(lambda s, d: _groups(s, d))
query("stream_pubsub", "", f"{PS} SELECT seq, conn, channel, message FROM msg JOIN sub USING (channel)")(lambda s, d: drained(p.fanout(source(s, d, "events").select(F.col("event_id").alias("seq"), F.concat("event_type", F.lit("."), (F.col("user_id") % 5).cast("string")).alias("channel"), F.col("props").alias("message")), subs(s, d))))


def _groups(s, d):
    """Each event adds an entry, the last of ten also reads all new ones; the first five of ten count as entries."""
    e = events(s, d)
    adds = e.filter("event_id % 10 < 5").select(F.col("event_type").alias("key"), F.lit("g").alias("grp"), F.col("event_id").alias("seq"), F.lit("ADD").alias("op"), F.lit("").alias("consumer"), F.col("event_id").alias("id_ms"), F.lit(0).cast("long").alias("id_seq"), F.lit(0).cast("long").alias("n"), F.col("ms").alias("now_ms"))
    reads = e.filter("event_id % 10 >= 5").select(F.col("event_type").alias("key"), F.lit("g").alias("grp"), (F.col("event_id") + 10_000_000).alias("seq"), F.lit("READ").alias("op"), F.lit("c1").alias("consumer"), F.lit(0).cast("long").alias("id_ms"), F.lit(0).cast("long").alias("id_seq"), F.lit(50).cast("long").alias("n"), F.col("ms").alias("now_ms"))
    out = drained(st.consumer_group(adds.unionByName(reads)))
    return out.filter("op = 'READ'").groupBy("key").agg(F.count("*").alias("delivered"))


def _moves(s, d):
    """Every third event moves an element from one list to another, the others push."""
    e = events(s, d)
    third = F.col("event_id") % 3 == 0
    name = F.col("event_id").cast("string")
    return e.select(F.col("event_type").alias("grp"), F.col("event_id").alias("seq"), F.when(third, "BLMOVE").otherwise("RPUSH").alias("op"), name.alias("conn"), F.array(F.lit("a")).alias("keys"), name.alias("value"), F.lit("b").alias("target"), F.lit("L").alias("side"), F.lit("R").alias("to_side"), F.lit(1).cast("long").alias("n"), F.col("ms").alias("now_ms"), F.lit(0).cast("long").alias("deadline_ms"))


query("stream_blmove", "", "WITH e AS (SELECT event_type AS grp, event_id, row_number() OVER (PARTITION BY event_type, event_id % 3 = 0 ORDER BY event_id) AS n, event_id % 3 = 0 AS pop FROM events) SELECT a.grp, a.event_id::VARCHAR AS conn, 'a' AS key, b.event_id::VARCHAR AS value FROM e a JOIN e b ON a.pop AND NOT b.pop AND a.grp = b.grp AND a.n = b.n")(lambda s, d: drained(st.blocking_lists(_moves(s, d), timers=False)))
