"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import scratch_path, shuffles_freed

# fixed values: the white space of [\x20\x09-\x0D] and the two cases of A-Z
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it lies."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, longer by underscores until no taken name equals it without case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def without(columns: list[str], *names: str) -> list[str]:
    """``columns`` but those that equal one of ``names`` without case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


class Scratch:
    """Written tables of one run; one that nothing reads any more can be deleted before the run ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, tag: str, df: DataFrame) -> DataFrame:
        """``df`` as a written table, in place of what was last put under ``tag``."""
        path = scratch_path(self.spark, tag)
        with shuffles_freed(self.spark):
            df.write.mode("error").parquet(path)
        self.drop(tag)
        self.paths[tag] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            if tag in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(tag))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
