"""Bounded runs of streaming plans: sources over files, and a run to the end of what there is."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from keyloom.functions.shared import remove, shared_dir


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a file stream, schema taken from the table."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")  # a file source takes folders and patterns


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming plan over everything its sources hold now, and read its sink."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
