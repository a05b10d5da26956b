"""Sinks.  Parquet is the working format; CSV and JSON are exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.operators.ordered import place_all
from gradeloom.schema import to_reference_blank
from gradeloom.session import existing

MANIFEST = "manifest"
FILE_CHARS = 1 << 26
CORPUS_ORDER = ["priority", "source_name", "essay_id"]


def in_corpus_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*CORPUS_ORDER)


def corpus_places(df: DataFrame) -> DataFrame:
    """``place`` of every record in output order."""
    return place_all(df, [F.col(c) for c in CORPUS_ORDER])


def write_corpus(df: DataFrame, folder: str) -> None:
    """Parquet, plus ordered CSV and JSON exports of it.  Spark writes no byte-order mark.

    The exports read the Parquet back, so the records are computed once.
    """
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    ordered = in_corpus_order(df.sparkSession.read.schema(df.schema).parquet(f"{folder}/parquet"))
    to_reference_blank(ordered).write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"').csv(f"{folder}/csv")
    ordered.write.mode("overwrite").json(f"{folder}/json")


def framed_text(df: DataFrame, by: str, order: str, line: Column, folder: str, head: Column, tail: Column | None = None,
                joint: str = "", file_chars: int | None = None) -> None:
    """One text file per value of ``by``: a head line, the lines of its rows in order, a tail line.

    ``joint`` stands before every line but the first.  A file is written by one task; with
    ``file_chars`` a longer one is cut, by ranges of the numeric ``order``, into files of about that
    many characters, each with its own head and tail.
    """
    files = ["_by", "_part"] if file_chars else ["_by"]
    dealt = df.withColumns({"_by": F.col(by), "_i": F.col(order), "_line": line})
    dealt = dealt.withColumn("_part", _file_part(dealt, file_chars) if file_chars else F.lit(0))
    rows = dealt.select("_by", "_part", F.lit(1).alias("_o"), "_i", F.col("_line").alias("value"))
    if joint:
        first = F.row_number().over(Window.partitionBy("_by", "_part").orderBy("_i")) == 1
        rows = rows.withColumn("value", F.when(first, F.col("value")).otherwise(F.concat(F.lit(joint), F.col("value"))))
    frame = [(0, head)] + ([(2, tail)] if tail is not None else [])
    ends = dealt.select("_by", "_part", F.explode(F.array(*[F.struct(F.lit(o).alias("_o"), text.alias("value")) for o, text in frame])).alias("e")).distinct()
    rows.unionByName(ends.select("_by", "_part", "e._o", F.lit(None).cast(df.schema[order].dataType).alias("_i"), "e.value")).repartition(
        "_by", "_part").sortWithinPartitions("_by", "_part", "_o", "_i").select(*files, "value").write.mode("overwrite").partitionBy(*files).text(folder)


def _file_part(rows: DataFrame, file_chars: int) -> Column:
    """Number of the file a row goes to within its ``_by``; only values with too long a file have cuts."""
    sizes = rows.groupBy("_by").agg(F.sum(F.length("_line")).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    k = -(-most // file_chars)
    part = F.lit(0)
    if k > 1:
        # one small row per value that is cut
        long = rows.join(sizes.where(F.col("n") > file_chars).select(F.col("_by").alias("_long")), F.col("_by").eqNullSafe(F.col("_long")))
        for r in long.groupBy("_by").agg(F.percentile_approx("_i", [i / k for i in range(1, k)], 10_000).alias("cuts")).collect():
            cuts = F.array(*[F.lit(c) for c in sorted(set(r["cuts"] or []))])
            part = F.when(F.col("_by").eqNullSafe(F.lit(r["_by"])), F.size(F.filter(cuts, lambda c: c < F.col("_i")))).otherwise(part)
    return part


def csv_line(columns: list[Column]) -> Column:
    """One record with every field in quotes; quotes inside are doubled."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def write_csv_files(df: DataFrame, folder: str, by: str, order: str, file_chars: int = FILE_CHARS) -> None:
    """Quoted CSV, one file per value of ``by`` or several when it is long, each with a byte-order mark and a header."""
    names = [c for c in df.columns if c != by]
    framed_text(df, by, order, csv_line([F.col(c) for c in names]), folder, F.lit("\ufeff" + ",".join(names)), file_chars=file_chars)


def write_json_arrays(df: DataFrame, folder: str, by: str, order: str, head: Column | None = None, member: str | None = None) -> None:
    """JSON files per value of ``by``: arrays of its rows, several when long, or one object with the fields of ``head`` and the array ``member``."""
    fields = [c for c in df.columns if c != by]
    opening = F.lit("[") if member is None else F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(f',"{member}":['))
    framed_text(df, by, order, F.to_json(F.struct(*fields)), folder, opening, F.lit("]" if member is None else "]}"), ",",
                FILE_CHARS if member is None else None)


def write_stage(df: DataFrame, folder: str, name: str, fmt: str = "json") -> str:
    """A stage that ``readers.stages`` and ``readers.stage`` load again: JSON lines or Parquet."""
    path = f"{folder.rstrip('/')}/stage_{name}.{'jsonl' if fmt == 'json' else fmt}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_tiers(records: DataFrame, folder: str, tier: str = "label_source") -> None:
    """One JSONL folder per trust tier; rows are ranged by tier and score so large tiers use many tasks."""
    (
        records.withColumn("tier", F.col(tier)).repartitionByRange("tier", F.desc("true_score"), "id")
        .sortWithinPartitions("tier", F.desc("true_score"), "id")
        .write.mode("overwrite").partitionBy("tier").json(folder)
    )


def write_document(df: DataFrame, path: str) -> None:
    """A nested one-row document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_run_parts(parts: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """First phase of a run: its parts lie in their folders, and no reader of ``readers.run_part`` sees them."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/run_id={run_id}")


def publish_run(spark: SparkSession, folder: str, run_id: str, names: list[str]) -> None:
    """Second phase: one manifest row, in one file that is renamed into place, makes all parts visible at once."""
    row = spark.createDataFrame([(sorted(names),)], "parts array<string>").coalesce(1)
    row.write.mode("error").parquet(f"{folder.rstrip('/')}/{MANIFEST}/run_id={run_id}")


def append_run(parts: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Append an evaluation under its run id: all parts, or none that a reader sees.

    A run that broke off before it was published is written anew under its id; a published one
    is never touched again.
    """
    spark = next(iter(parts.values())).sparkSession
    if existing(spark, [f"{folder.rstrip('/')}/{MANIFEST}/run_id={run_id}/_SUCCESS"]):
        raise ValueError(f"run {run_id} is already published")
    write_run_parts(parts, folder, run_id)
    publish_run(spark, folder, run_id, list(parts))
