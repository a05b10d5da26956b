"""op8: licenses of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.common import read
from gradeloom.llm.license_scan import scan_licenses
from gradeloom.llm.registry import query


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
