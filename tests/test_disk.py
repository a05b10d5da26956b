import os
import time

from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch
from gradeloom.session import delete_table, write_table


def shuffle_files(spark):
    """Names of the shuffle files that lie in the folders of this session."""
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in root for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_behind(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = shuffle_files(spark)
    table, path = write_table(rows, "counts")
    tables = Scratch(spark)
    kept = tables.put("counts", rows)
    wait = time.time() + 10
    while shuffle_files(spark) - before and time.time() < wait:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert table.agg(F.sum("n")).first()[0] == kept.agg(F.sum("n")).first()[0] == 1000
    delete_table(spark, path)
    tables.drop("counts")
