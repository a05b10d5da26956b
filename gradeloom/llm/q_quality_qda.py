"""op5: quality scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.common import read
from gradeloom.llm.quality_qda import scored
from gradeloom.llm.registry import query


@query("op5_quality_qda")
def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
