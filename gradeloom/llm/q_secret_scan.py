"""op2: secrets of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.common import read, sha
from gradeloom.llm.registry import query
from gradeloom.llm.secret_scan import scanned


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", sha("base").alias("base_sha256"), "spans")
