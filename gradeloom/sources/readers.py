"""Sources.  Every reader states its schema; nothing is inferred."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from gradeloom import schema as S
from gradeloom.functions import text as X
from gradeloom.operators.ordered import place_all
from gradeloom.sources.ranges import csv_fields, csv_records, json_objects
from gradeloom.sources.writers import MANIFEST


# array files from elsewhere, and the two layouts that ``writers.write_stage`` writes
STAGE_SUFFIXES = (".json", ".jsonl", ".parquet")


def _stage_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of one stage path or glob, by its suffix; None where nothing is there."""
    reader = spark.read.schema(S.ESSAY if path.endswith(".parquet") else S.STAGE_JSON)
    try:
        if path.endswith(".parquet"):
            return reader.parquet(path)
        return reader.option("multiLine", path.endswith(".json")).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def stages(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of a folder as one DataFrame with an ingest ordinal (file, then row in the file).

    Parquet numbers its rows itself.  A split of a text file counts from the byte at which it
    starts, so pieces of one large file keep their order and never share an ordinal: a row has
    more than one byte.
    """
    found = [_stage_rows(spark, f"{folder.rstrip('/')}/stage_*{suffix}") for suffix in STAGE_SUFFIXES]
    found = [df for df in found if df is not None]
    if not found:
        return spark.createDataFrame([], S.ESSAY).withColumn("ordinal", F.lit(None).cast("bigint"))
    # File names come from the scans' own listings, so numbering them costs no second read.
    inside = r"/(stage_[^/]+(?:/[^/]+)?)$"
    names = sorted({re.search(inside, unquote(path))[1] for df in found for path in df.inputFiles()})
    files = spark.createDataFrame(list(enumerate(names)), "_no int, _file string")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))

    def placed(df: DataFrame) -> DataFrame:
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        has_index = "row_index" in df.select("_metadata").schema["_metadata"].dataType.names
        at = F.col("_metadata.row_index") if has_index else F.col("_metadata.file_block_start") + row
        return _typed(df.select("*", F.regexp_extract(path, inside, 1).alias("_file"), at.alias("_row")))
    every = union_stages(*[placed(df) for df in found])
    return every.join(files, "_file").withColumn("ordinal", F.col("_no") * F.lit(1 << 42) + F.col("_row")).drop("_file", "_row", "_no")


def _typed(df: DataFrame) -> DataFrame:
    out = S.nulls_for_blank(df)
    return out.withColumns({
        "score": F.col("score").try_cast("double"),
        "collected_at": F.try_to_date(F.col("collected_at").cast("string"), "yyyy-MM-dd"),
    })


def stage(spark: SparkSession, path: str) -> DataFrame:
    """One stage, or an empty DataFrame of the same schema when it is missing."""
    rows = _stage_rows(spark, path)
    return spark.createDataFrame([], S.ESSAY) if rows is None else _typed(rows)


def corpus_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Quoted CSV with a BOM, line breaks inside quotes and doubled quotes; odd-length rows are dropped.

    Many tasks read one file.  Every file starts with its header; without ``schema`` the first one
    names the columns, all text.  A row with a value that its column's type does not take is dropped.
    """
    rows = csv_records(spark, path)
    is_header = (F.col("start") == 0) & (F.col("no") == 0)
    if schema is None:
        first = rows.where(is_header).orderBy("file").select(csv_fields(F.col("text")).alias("f")).first()
        names = [c.lstrip("\ufeff") if i == 0 else c for i, c in enumerate(first["f"] if first else [])]
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in names])
    fields = X.computed_once(rows.where(~is_header), _f=csv_fields(F.col("text"))).where(F.size("_f") == len(schema))
    cells = [(f, F.get("_f", F.lit(i))) for i, f in enumerate(schema)]
    for f, cell in cells:
        if not isinstance(f.dataType, T.StringType):
            fields = fields.where((F.trim(cell) == "") | cell.try_cast(f.dataType).isNotNull())
    return S.nulls_for_blank(fields.select(*[
        (cell if isinstance(f.dataType, T.StringType) else cell.try_cast(f.dataType)).alias(f.name) for f, cell in cells]))


def members(spark: SparkSession, path: str, schema: T.StructType, member: str | None = None) -> DataFrame:
    """(file, ordinal, fields...) of the objects of one array; ordinals count from 0 in each file."""
    rows = json_objects(spark, path, member).select("file", "start", "no", F.from_json("text", schema).alias("_v"))
    placed = place_all(rows, [F.col("start"), F.col("no")], ["file"])
    return placed.select("file", (F.col("place") - 1).cast("int").alias("ordinal"), "_v.*")


def posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.POST).option("mode", "FAILFAST").json(path)


def comment_threads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.COMMENT_THREAD).option("mode", "DROPMALFORMED").json(path)


def forum_threads(spark: SparkSession, path: str) -> DataFrame:
    """Thread array files, read by many tasks each: one row per thread with its posts as arrays."""
    return json_objects(spark, path).select(F.from_json("text", S.FORUM_THREAD).alias("t")).select("t.*")


def side_dates(spark: SparkSession, path: str) -> DataFrame:
    """'tid:yyyymmdd,...' to (tid, iso_date); other values are skipped, the last entry of an id counts."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("o"), F.posexplode(F.split("value", ",")).alias("i", "pair"))
    ymd = F.element_at(F.split(F.trim("pair"), ":"), 2)
    parts = rows.where(F.col("pair").rlike(r"^\s*[^:]*:\d{8}\s*$")).select(
        "o", "i", F.element_at(F.split(F.trim("pair"), ":"), 1).alias("tid"), ymd.alias("ymd"))
    iso = F.concat_ws("-", F.substring("ymd", 1, 4), F.substring("ymd", 5, 2), F.substring("ymd", 7, 2))
    return parts.groupBy("tid").agg(F.max_by(iso, F.struct("o", "i")).alias("iso_date"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SNAPSHOT).option("sep", "\t").csv(path)


def ok_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status") == 200)


def rows_with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.startswith(F.col(column), F.lit(prefix)))


def knowledge_base(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four documents, flattened to rows that can be joined."""
    def doc(name, schema):
        return spark.read.schema(schema).option("multiLine", True).json(f"{folder.rstrip('/')}/{name}")

    rubric = doc("rubric.json", S.RUBRIC)
    level = rubric.select(F.explode("levels").alias("l"))
    criteria = level.select(
        "l.score", "l.summary", F.posexplode_outer("l.criteria").alias("axis_no", "c")
    ).select("score", "summary", "axis_no", F.col("c.axis").alias("axis"), F.col("c.descriptor").alias("descriptor"))

    def listed(name, whole, member):
        rows = members(spark, f"{folder.rstrip('/')}/{name}", whole[member].dataType.elementType, member)
        return rows.drop("file")
    return {
        "axes": rubric.select(F.posexplode("axes").alias("axis_no", "a")).select("axis_no", "a.*"),
        "criteria": criteria,
        "anchors": listed("anchors.json", S.ANCHOR_DOC, "anchors"),
        "anchor_prompts": listed("anchors.json", S.ANCHOR_DOC, "prompts"),
        "topics": listed("prompts_issue.json", S.TOPIC_DOC, "topics"),
        "style": doc("style_exemplars.json", S.STYLE_DOC),
    }


def evaluation_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per prediction of every run file; many tasks read the predictions of one file."""
    head = spark.read.schema(T.StructType([S.EVAL_RUN["provider"], S.EVAL_RUN["model"]])).option("multiLine", True).json(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("run_id"), "provider", "model")
    rows = members(spark, path, S.PREDICTION, "predictions")
    return rows.join(head, "file").select(
        "run_id", "provider", "model", "ordinal", "id", F.col("trueScore").alias("true_score"),
        F.col("predictedScore").alias("predicted_score"), F.col("labelSource").alias("label_source"), "samples")


def run_part(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One part of all published runs, with ``run_id``; runs that broke off before publication are not there."""
    root = folder.rstrip("/")
    runs = spark.read.schema("parts array<string>, run_id string").parquet(f"{root}/{MANIFEST}").where(F.array_contains("parts", name))
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.withColumn("run_id", F.col("run_id").cast("string")).join(runs.select("run_id"), "run_id", "left_semi")


def union_stages(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def shuffled_prefix(df: DataFrame, key: str, n: int, seed: int = 20240808) -> DataFrame:
    """First ``n`` rows of a fixed pseudo-random order: any prefix is representative and resumable."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
