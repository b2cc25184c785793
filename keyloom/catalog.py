"""Every registered query over the keyed views of the test tables, with the SQL that answers the same question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.operators import zsets
from keyloom.plans import json_sketch_queries, key_stream_queries, list_string_queries, set_hash_queries, streaming_queries, zset_queries  # noqa: F401  they register their queries
from keyloom.plans.views import ORACLES, QUERIES, zst

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zsets.zrange(zst(spark, sf_dir), 0, 9, reverse=True)
