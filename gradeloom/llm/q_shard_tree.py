"""op7: all documents in 16 shards of a hash tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import read
from gradeloom.llm.registry import query
from gradeloom.llm.shard_tree import placed, planned

SHARDS = 16


@query("op7_shard_tree")
def op7_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(read(spark, sf_dir, "documents").select("doc_id", "text"), planned(SHARDS))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint"), "grown_shard")
