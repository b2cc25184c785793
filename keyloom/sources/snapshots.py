"""Snapshots and dumps: a directory of Parquet per element table with a manifest, and checksummed single-key payloads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1
MANIFEST = "version int, now_ms long, folder string, tables array<string>, schemas array<string>"


def save(tables: dict[str, DataFrame], path: str, now_ms: int) -> None:
    """SAVE: every table in a fresh folder, partitioned by db where it has one, and then a row of the manifest that names the
    folder. Until that row stands, the snapshot before is the one that is loaded; a failed save leaves it whole."""
    spark, fresh = None, f"set-{now_ms}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        spark = df.sparkSession
        (df.write.partitionBy("db") if "db" in df.columns else df.write).parquet(f"{path}/{fresh}/{name}")
    if spark is not None:
        spark.createDataFrame([(VERSION, now_ms, fresh, sorted(tables), [tables[n].schema.json() for n in sorted(tables)])], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_manifest")


def _latest(spark: SparkSession, path: str) -> Row:
    """The newest row of the manifest; of equal times, the one with the last folder name."""
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest").orderBy(F.desc("now_ms"), F.desc("folder")).first()


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], int]:
    """(tables, time of the snapshot)."""
    m = _latest(spark, path)
    read = lambda name, schema: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{m['folder']}/{name}")
    return {name: read(name, schema) for name, schema in zip(m["tables"], m["schemas"], strict=True)}, m["now_ms"]


def lastsave(spark: SparkSession, path: str) -> int:
    return _latest(spark, path)["now_ms"] // 1000


def dump(df: DataFrame) -> DataFrame:
    """(key, payload) of any element table: a key's rows as ordered JSON, the version and a CRC-32."""
    cols = [c for c in df.columns if c != "key"]
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(*cols))))
    body = F.concat(F.lit(f"{VERSION}:"), rows)
    return df.groupBy("key").agg(body.alias("body")).select("key", F.concat(F.lpad(F.hex(F.crc32(F.col("body").cast("binary"))), 8, "0"), F.lit(":"), F.col("body")).alias("payload"))


def restore(df: DataFrame, payloads: DataFrame, *, replace: bool = False) -> DataFrame:
    """Next version of df with keys of (key, payload); a taken key raises unless replace; damaged payloads raise."""
    kind = f"array<{df.drop('key').schema.simpleString()}>"
    body = F.col("payload").substr(F.lit(10), F.length("payload"))
    sound = F.col("payload").substr(1, 8) == F.lpad(F.hex(F.crc32(body.cast("binary"))), 8, "0")
    text = F.when(sound, body.substr(F.lit(len(str(VERSION)) + 2), F.length(body))).otherwise(F.raise_error(F.lit("DUMP payload version or checksum are wrong")).cast("string"))
    rows = payloads.select("key", F.inline(F.from_json(text, kind)))
    if replace:
        return df.join(payloads.select("key").distinct(), "key", "left_anti").unionByName(rows)
    taken = payloads.join(df.select("key").distinct(), "key", "left_semi").select(F.raise_error(F.lit("BUSYKEY Target key name already exists.")).cast("string").alias("x"))
    return df.unionByName(rows.join(taken.filter(F.col("x").isNotNull()), F.lit(True), "left_anti"))
