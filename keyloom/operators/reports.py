"""Reports over the key and element tables: INFO keyspace, DBSIZE, MEMORY USAGE, DEBUG, command statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dbsize(k: DataFrame) -> DataFrame:
    return k.agg(F.count("*").alias("keys"))


def keyspace(k: DataFrame) -> DataFrame:
    """Keys and expiring keys of each database."""
    return k.groupBy("db").agg(F.count("*").alias("keys"), F.count("expire_at_ms").alias("expires"))


def flushdb(k: DataFrame, db: int) -> DataFrame:
    return k.filter(F.col("db") != db)


def flushall(k: DataFrame) -> DataFrame:
    return k.limit(0)


def type_counts(k: DataFrame) -> DataFrame:
    return k.groupBy("type").agg(F.count("*").alias("keys"))


def memory_usage(s: DataFrame) -> DataFrame:
    """Modelled bytes of a string key: texts of up to 15 bytes live inside their 16-byte cell, longer ones beside it."""
    own = lambda c: F.when(F.octet_length(c) <= 15, 16).otherwise(16 + F.octet_length(c))
    return s.select("key", (own(F.col("key").cast("string")) + own(F.col("value"))).cast("long").alias("bytes"))


def populate(spark: SparkSession, n: int, prefix: str = "key", size: int = 16) -> DataFrame:
    """DEBUG POPULATE: n string keys, made on the executors."""
    return spark.range(n).select(F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")).alias("key"), F.rpad(F.concat(F.lit("value:"), F.col("id").cast("string")), size, "x").alias("value"))


def unique_strings(elements: DataFrame, exact: bool = False) -> DataFrame:
    """(type, text) -> per type: total, unique (estimated unless exact), bytes, mean bytes and bytes saved by sharing."""
    n = F.octet_length("text").cast("long")
    unique = F.count_distinct("text") if exact else F.approx_count_distinct("text", 0.02)
    g = elements.groupBy("type").agg(F.count("*").alias("total"), unique.alias("unique"), F.sum(n).alias("bytes"))
    g = g.withColumn("mean_bytes", F.round(F.col("bytes") / F.col("total"), 3))
    return g.withColumn("saved", F.round((F.col("total") - F.col("unique")) * F.col("bytes") / F.col("total"), 3))


def command_stats(log: DataFrame) -> DataFrame:
    """log (name, micros) -> calls and microseconds of each command."""
    return log.groupBy("name").agg(F.count("*").alias("calls"), F.sum("micros").alias("micros"), F.round(F.avg("micros"), 3).alias("micros_per_call"))


def slowlog(log: DataFrame, threshold_us: int = 10_000, n: int = 20) -> DataFrame:
    """The latest n commands that took threshold_us or more."""
    return log.filter(F.col("micros") >= threshold_us).orderBy(F.desc("seq")).limit(n)


def histogram(values: DataFrame, column: str, bins: int = 154) -> DataFrame:
    return values.agg(F.histogram_numeric(column, F.lit(bins)).alias("bins"), F.percentile_approx(column, [0.5, 0.9, 0.99]).alias("percentiles"))
