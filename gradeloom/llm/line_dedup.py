"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, known by a
128-bit digest.  ``LineStore`` keeps, in one folder that every executor can read,

* ``refs``: one row (shard, k1, k2, doc_id) per key and document, the exact truth;
* ``counts``: per key its number of documents and the largest doc_id;
* ``filters``: one cuckoo filter per shard with every key that has a reference.

Inserting documents asks the filter of a shard which of the new keys it may know: only those
are joined with the exact counts, the others start a count of their own.  Deleting documents
subtracts their references, deletes from the filter the keys whose last reference went, and
recounts only the touched keys, so insert followed by delete restores every decision.  Every
change writes a new version of the tables; the old one stays readable until ``forget``.

Keys are spread by their digest, so no document or source makes a shard large; a very common
line is one partial count per task.  Shards are cut so that one holds about ``SHARD_KEYS``, and
cut anew when an insert takes them above that.  The first load of an empty store goes in
``ROUNDS`` rounds by a hash of doc_id: the first round starts the counts and filters, every later
one asks the filters of the rounds before it.

Defined cases: null or empty text is one empty line; short keys always stay; repeated rows of
one doc_id count as one document and each row keeps its own lines; a null doc_id refers to
nothing, and its lines stay; other columns pass through unread, whatever their names and case.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import free_name, without
from gradeloom.llm.cuckoo import CuckooFilter
from gradeloom.session import scratch_path

MIN_POINTS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 18
ROUNDS = 2
BATCH_BYTES = 1 << 22

KEY = ["shard", "k1", "k2"]


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8"))


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def line_digests(text: str | None, min_points: int) -> list[bytes | None]:
    """Per line its digest, or None for a key too short to count."""
    out = []
    for line in (text or "").encode("utf-8").lower().split(b"\n"):
        key = line.strip()  # of bytes: just the six blanks
        out.append(_digest(key) if len(key) >= min_points and _points(key) >= min_points else None)
    return out


def references(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(k1, k2, doc_id) once per document row and counted key."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, n, got, owner = batch.column(0).to_pylist(), 0, [], []
            for i, text in enumerate(batch.column(1)):
                if ids[i] is not None:
                    own = {d for d in line_digests(text.as_py(), min_points) if d}
                    got.extend(own)
                    owner.extend([ids[i]] * len(own))
                    n += 40 * len(own)
                if n > BATCH_BYTES or i + 1 == batch.num_rows:
                    halves = np.frombuffer(b"".join(got), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(owner, pa.int64())], ["k1", "k2", "doc_id"])
                    got, owner, n = [], [], 0
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        batches, "k1 bigint, k2 bigint, doc_id bigint")


class LineStore:
    """Reference tables and filters of all documents inserted so far."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_points: int = MIN_POINTS, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_points, self.shard_keys = spark, min_points, shard_keys
        self.folder = folder or scratch_path(spark, "line-store")
        self.version, self.shards = 0, 0

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.folder}/{name}-{self.version if version is None else version}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def _sharded(self, refs: DataFrame) -> DataFrame:
        return refs.select(F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard"), "k1", "k2", "doc_id")

    @staticmethod
    def _counted(refs: DataFrame) -> DataFrame:
        return refs.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))

    def _write(self, version: int, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self._at(name, version))
        return self.spark.read.parquet(self._at(name, version))

    def _filters(self, counts: DataFrame) -> DataFrame:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = (pdf["k1"].to_numpy() ^ pdf["k2"].to_numpy()).astype(np.uint64)
            made = CuckooFilter.sized(len(keys))
            while not made.insert(keys):
                made = CuckooFilter(made.buckets * 2)
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [made.dump()]})
        return counts.select(*KEY).groupBy("shard").applyInPandas(build, "shard int, filter binary")

    def load(self, docs: DataFrame) -> None:
        """First content of an empty store."""
        rows = self._write(ROUNDS, "raw", references(docs, self.min_points).distinct())
        self.shards = max(1, -(-rows.count() // self.shard_keys))
        for v in range(1, ROUNDS + 1):
            mine = self._counted(self._sharded(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == v - 1)))
            if v == 1:
                self._write(v, "filters", self._filters(self._write(v, "counts", mine)))
            else:
                asked = self._write(v, "asked", self.maybe_known(mine))
                self._absorb(v, asked.where("not known").drop("known"), asked.where("known").drop("known"))
            self.version = v

    def _absorb(self, v: int, new: DataFrame, known: DataFrame) -> None:
        """Counts and filters of version ``v`` from counts of new references: only keys the filter may know meet the exact counts."""
        old = self.table("counts")
        more = known.select(*KEY, F.col("n").alias("dn"), F.col("last").alias("dlast"))
        counts = old.join(more, KEY, "full_outer").select(
            *KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), F.greatest("last", "dlast").alias("last"))
        starts = more.join(old.select(*KEY), KEY, "left_anti").select(*KEY).unionByName(new.select(*KEY))
        self._write(v, "counts", counts.unionByName(new))
        self._write(v, "filters", self._changed_filters(starts, add=True, version=v))

    def refs(self) -> DataFrame:
        return self._sharded(self.table("raw"))

    def maybe_known(self, keys: DataFrame) -> DataFrame:
        """``keys`` (shard, k1, k2, ...) with ``known``: False means certainly without a reference."""
        schema = keys.schema

        def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            k = (left["k1"].to_numpy() ^ left["k2"].to_numpy()).astype(np.uint64)
            known = CuckooFilter.load(right["filter"].iloc[0]).contains(k) if len(right) else np.zeros(len(k), bool)
            return left.assign(known=known)
        out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", known boolean"
        return keys.groupBy("shard").cogroup(self.table("filters").groupBy("shard")).applyInPandas(ask, out)

    def _reshard(self, shards: int) -> None:
        """The same content as a new version with more shards."""
        v = self.version + 1
        self.shards = shards
        self._write(v, "raw", self.table("raw"))
        counts = self._write(v, "counts", self.table("counts").withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")))
        self._write(v, "filters", self._filters(counts))
        self.version = v

    def insert(self, docs: DataFrame) -> None:
        """Add documents; ids already held add only the lines they did not have."""
        if not self.version:
            return self.load(docs)
        rows = self._write(self.version + 1, "new", references(docs, self.min_points).distinct())
        shards = -(-(self.table("raw").count() + rows.count()) // self.shard_keys)
        if shards > self.shards:
            self._reshard(shards)
        v = self.version + 1
        fresh = self._write(v, "batch", self._sharded(rows))
        asked = self._write(v, "asked", self.maybe_known(fresh.select(*KEY).distinct()))
        known = fresh.join(asked.where("known").select(*KEY), KEY, "left_semi")
        held = self.refs().join(asked.where("known").select(*KEY), KEY, "left_semi")
        added = fresh.join(asked.where("not known").select(*KEY), KEY, "left_semi").unionByName(
            known.join(held, [*KEY, "doc_id"], "left_anti"))
        added = self._write(v, "added", added)
        mine = self._counted(added)
        self._write(v, "raw", self.table("raw").unionByName(added.select("k1", "k2", "doc_id")))
        self._absorb(v, mine.join(asked.where("not known").select(*KEY), KEY, "left_semi"),
                     mine.join(asked.where("known").select(*KEY), KEY, "left_semi"))
        self.version = v

    def delete(self, doc_ids: DataFrame) -> None:
        """Remove all references of the named documents; unknown ids change nothing."""
        v = self.version + 1
        ids = doc_ids.select(F.col("doc_id").cast("bigint")).where("doc_id is not null").distinct()
        raw = self._write(v, "raw", self.table("raw").join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"))
        gone = self._write(v, "gone", self.refs().join(ids, "doc_id", "left_semi").select(*KEY).distinct())
        old = self.table("counts")
        again = self._counted(self._sharded(raw).join(gone, KEY, "left_semi"))
        counts = self._write(v, "counts", old.join(gone, KEY, "left_anti").unionByName(again))
        ended = gone.join(counts.select(*KEY), KEY, "left_anti")
        self._write(v, "filters", self._changed_filters(ended, add=False, version=v))
        self.version = v

    def _changed_filters(self, keys: DataFrame, add: bool, version: int) -> DataFrame:
        def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            k = (left["k1"].to_numpy() ^ left["k2"].to_numpy()).astype(np.uint64)
            data = right["filter"].iloc[0] if len(right) else CuckooFilter.sized(len(k)).dump()
            shard = int((right if len(right) else left)["shard"].iloc[0])
            held = CuckooFilter.load(data)
            if not add:
                held.delete(k)
            elif not held.insert(k):
                # a full filter cannot grow without its keys: empty means "ask the exact table for all"
                held = CuckooFilter(held.buckets, np.zeros((0, 4), np.uint16))
            return pd.DataFrame({"shard": [shard], "filter": [held.dump() if len(held.table) else b""]})
        out = keys.groupBy("shard").cogroup(self.table("filters").groupBy("shard")).applyInPandas(change, "shard int, filter binary")
        full = out.where(F.length("filter") == 0)
        rebuilt = self._filters(self.spark.read.parquet(self._at("counts", version)).join(full.select("shard"), "shard", "left_semi"))
        return out.where(F.length("filter") > 0).unionByName(rebuilt) if add else out

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, drop): digests of the lines each document loses."""
        common = self.table("counts").where(F.col("n") >= min_docs).select("k1", "k2", "last")
        return (
            self.table("raw").join(common, ["k1", "k2"]).where("doc_id < last")
            .groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))
        )

    def kept(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """All columns of ``docs`` with ``text`` cleaned, and n_lines and n_dropped of each row."""
        return remove_lines(docs, self.drops(min_docs), self.min_points)

    def forget(self) -> None:
        """Delete the versions before the current one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for v in range(1, self.version):
            for name in ("raw", "counts", "filters", "new", "batch", "asked", "added", "gone"):
                p = hadoop(self._at(name, v))
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_lines(docs: DataFrame, drops: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Apply drop lists; a document has its lines and its list in one row, and nothing more.

    Adds ``n_lines`` and ``n_dropped``; columns of these names are replaced.
    """
    rest = without(docs.columns, "text", "n_lines", "n_dropped")
    owner, gone_lines = free_name("_drop_id", docs.columns), free_name("_drop", docs.columns)
    lists = drops.select(F.col("doc_id").alias(owner), F.transform(
        "drop", lambda d: F.concat(*[F.lpad(F.hex(d[c]), 16, "0") for c in ("k1", "k2")])).alias(gone_lines))
    joined = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias("text")).join(
        lists, F.col("doc_id").cast("bigint") == F.col(owner), "left").drop(owner)
    at_text, at_drop = len(rest), len(rest) + 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at_text).to_pylist(), batch.column(at_drop).to_pylist(), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                if drop:
                    gone = {np.array([int(d[:16], 16), int(d[16:], 16)], np.uint64).tobytes() for d in drop}
                    kept = [line for line, d in zip(text.split("\n"), line_digests(text, min_points), strict=True) if d not in gone]
                    n_dropped.append(n - len(kept))
                    text = "\n".join(kept)
                else:
                    n_dropped.append(0)
                texts.append(text)
                n_lines.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at_text], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*rest, "text", "n_lines", "n_dropped"])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "text string", "n_lines bigint", "n_dropped bigint"])
    return joined.mapInArrow(batches, schema)
