"""Continuous versions of the incremental steps."""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.functions.signals import with_signals
from gradeloom.session import delete_table, existing, write_table

BUCKETS = 64

# ---- fixed values: calls allowed per client and endpoint in one minute --------------------
PAID_LIMIT, LIGHT_LIMIT, WINDOW = 3, 20, "60 seconds"
# -------------------------------------------------------------------------------------------


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def harvest(stream: DataFrame, id_col: str = "id", ts: str = "ts", delay: str = "30 days") -> DataFrame:
    """Rows whose id has not been seen within the watermark, for streams in flight; ``harvest_into`` has no age."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def harvest_into(stream: DataFrame, path: str, checkpoint: str, id_col: str = "id", buckets: int = BUCKETS) -> None:
    """Append rows whose id the sink does not hold yet, however old it is; then stop.

    Beside the rows lies an index of the ids alone, ``_seen``, in ``buckets`` hash buckets.  A
    micro-batch reads the buckets of its own ids and nothing else of what came before.  It claims
    its new ids in the index, then writes their rows, both under the name of (checkpoint, batch)
    and in place of what an earlier try left there; so a batch that stops anywhere and runs again
    adds every row once.  One harvest at a time may write to a sink.

    Rows without an id (null or empty) are passed over.  Of several rows with one id in a batch the
    smallest stays.  ``buckets`` must not change while a sink grows.
    """
    spark = stream.sparkSession
    index = f"{path.rstrip('/')}/_seen"
    run = sha1(checkpoint.encode()).hexdigest()[:12]
    rest = [c for c in stream.columns if c != id_col]

    def append(batch: DataFrame, number: int) -> None:
        held = F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")
        one = batch.where(held).groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_r") if rest else F.count("*").alias("_r"))
        one = one.select(id_col, *(["_r.*"] if rest else []), F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("_bucket"))
        one, written = write_table(one, "harvest")
        claim = f"{run}-{number}"
        touched = [r[0] for r in one.select("_bucket").distinct().collect()]
        paths = existing(spark, [f"{index}/_bucket={b}" for b in touched])
        fresh = one
        if paths:
            seen = spark.read.option("basePath", index).schema(f"`{id_col}` {stream.schema[id_col].dataType.simpleString()}, _bucket int, claim string").parquet(*paths)
            fresh = one.join(seen.where(F.col("claim") != claim).select(id_col), id_col, "left_anti")
        replace = {"partitionOverwriteMode": "dynamic"}
        fresh.select(id_col, "_bucket", F.lit(claim).alias("claim")).repartition("_bucket").write.mode("overwrite").options(
            **replace).partitionBy("_bucket", "claim").parquet(index)
        fresh.select(*stream.columns, F.lit(claim).alias("claim")).write.mode("overwrite").options(
            **replace).partitionBy("claim").parquet(path)
        delete_table(spark, written)

    spark.createDataFrame([], stream.schema).write.mode("append").parquet(path)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ceiling_breaches(stream: DataFrame, limits: dict[str, int], default: int = LIGHT_LIMIT, endpoint: str = "endpoint",
                     client: str = "client", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Windows in which a client exceeded an endpoint's ceiling.

    Counts are partial per task before the shuffle, so one busy client is cheap.
    """
    limit = F.coalesce(*[F.when(F.col(endpoint) == e, n) for e, n in limits.items()], F.lit(default))
    src = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    counts = src.groupBy(F.window(ts, WINDOW).alias("w"), endpoint, client).agg(F.count("*").alias("calls"))
    return counts.withColumn("allowed", limit).where("calls > allowed").select(
        F.col("w.start").alias("window_start"), endpoint, client, "calls", "allowed",
        (F.col("calls") - F.col("allowed")).alias("blocked"))


def signals_on_arrival(stream: DataFrame, essay: str = "essay", statement: str = "statement", **lexicons) -> DataFrame:
    """Stateless: the batch expression applied to each arriving row."""
    return with_signals(stream, essay, statement, **lexicons)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what is there, then stop; the next call resumes from the checkpoint."""
    query = (
        stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
