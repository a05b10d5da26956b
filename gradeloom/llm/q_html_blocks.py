"""op3: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.common import read
from gradeloom.llm.html_blocks import extracted
from gradeloom.llm.registry import query


@query("op3_html_blocks")
def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
