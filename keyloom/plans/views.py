"""Keyed views over the test tables, in Spark and as SQL, and the registry of queries over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PART_ROWS = 250_000  # rows of a table that one task takes
NOW_MS = 852_076_800_000  # the pinned clock of every query: 1997-01-01

SQL_VIEWS = {
    "zst": "SELECT c_nationkey AS key, c_custkey AS member, c_acctbal AS score FROM customer",
    "st": "SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders",
    "hsh": """SELECT o_orderkey AS key, 'status' AS field, o_orderstatus AS value FROM orders
              UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders
              UNION ALL SELECT o_orderkey, 'cust', o_custkey::VARCHAR FROM orders WHERE o_custkey % 3 > 0""",
    "lst": """SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
              l_partkey AS value FROM lineitem""",
    "str": "SELECT doc_id AS key, text AS value FROM documents",
    "bit": "SELECT DISTINCT event_type AS key, user_id AS pos FROM events",
    "xen": """SELECT key, id_ms, row_number() OVER (PARTITION BY key, id_ms ORDER BY event_id) - 1 AS id_seq, event_id, user_id, value
              FROM (SELECT event_type AS key, epoch_us(ts) // 1000 AS id_ms, event_id, user_id, value FROM events)""",
    "jsn": "SELECT event_id AS key, props AS doc FROM events",
    "geo": "SELECT c_nationkey AS key, c_custkey AS member, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon, (c_custkey * 17 % 170 - 85)::DOUBLE AS lat FROM customer",
    "ksp": """SELECT (o_orderkey % 4)::INTEGER AS db, 'o:' || o_orderkey AS key, CASE o_orderkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'hash' ELSE 'set' END AS type,
              CASE WHEN o_orderkey % 5 > 0 THEN epoch_us(o_orderdate) // 1000 END AS expire_at_ms, o_orderkey % 11 = 0 AS sticky,
              o_orderkey % 2 = 0 AS touched, (o_orderkey * 7 % 100)::BIGINT AS bytes FROM orders""",
}


def sql(views: str, body: str) -> str:
    """SQL over the named views."""
    return "WITH " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views.split()) + "\n" + body


def query(name: str, views: str = "", body: str | None = None) -> Callable:
    """Register a query, with its SQL over the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if body is not None:
            ORACLES[name] = sql(views, body) if views else body
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def millis(c: str) -> Column:
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("long")


def zst(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("member"), F.col("c_acctbal").alias("score"))


def st(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member")).distinct()


def hsh(spark: SparkSession, d: str) -> DataFrame:
    """Unpivoted in one scan."""
    o = table(spark, d, "orders")
    pairs = [("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority")), ("cust", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")))]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in pairs])).alias("p")
    return o.select(F.col("o_orderkey").alias("key"), cells).select("key", "p.field", "p.value").filter(F.col("value").isNotNull())


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key in parts of about PART_ROWS, so that the sorts and aggregates that follow in one task do not grow
    with the table; a smaller table is left to the settings. The count reads no column."""
    parts = -(-rows.count() // PART_ROWS)
    return rows.repartition(parts, key) if parts > 1 else rows


def lst(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return dealt(table(spark, d, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("l_partkey").alias("value"))


def strs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))


def bit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("pos")).distinct()


def xen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), millis("ts").alias("id_ms"), "event_id", "user_id", "value")
    w = W.partitionBy("key", "id_ms").orderBy("event_id")
    return e.withColumn("id_seq", (F.row_number().over(w) - 1).cast("long")).select("key", "id_ms", "id_seq", "event_id", "user_id", "value")


def jsn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("props").alias("doc"))


def geo(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), k.alias("member"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 170 - 85).cast("double").alias("lat"))


def ksp(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "string").when(k % 3 == 1, "hash").otherwise("set")
    return table(spark, d, "orders").select(
        (k % 4).cast("int").alias("db"), F.concat(F.lit("o:"), k.cast("string")).alias("key"), kind.alias("type"),
        F.when(k % 5 > 0, millis("o_orderdate")).alias("expire_at_ms"), (k % 11 == 0).alias("sticky"), (k % 2 == 0).alias("touched"), (k * 7 % 100).cast("long").alias("bytes"),
    )
