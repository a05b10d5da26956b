"""Records of quoted CSV and JSON array files, read by many tasks per file.

Neither format can be cut at a byte without knowing what stands before it: a line break may lie
inside quotes, a brace inside a string.  So a file is read twice, both times in the byte ranges
that Spark's text source deals out:

1. every range says how it changes the state, whatever state it starts in: the parity of its
   quotes and, for JSON, the change of depth if it starts outside or inside a string;
2. a prefix over the ranges of a file (one narrow row each) gives the state at every start;
3. every range is cut into records by that state.  What begins before a range or does not end in
   it is a fragment; fragments alone are shuffled and joined to whole records.

A task holds one batch of text and one open record.  A record that never closes, as after a stray
quote, is one record to the end of the file, as the formats define it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.session import materialise

CHUNK_BYTES = 1 << 22
STATE = "file string, start bigint, parity int, outside bigint, inside bigint"
PIECE = "file string, start bigint, no bigint, kind string, key string, text string"

Chunk = tuple[tuple[str, int], list[bytes]]


def _ranges(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """((file, start), separated values) in file order; a chunk holds values of one range."""
    at, held, size = None, [], 0
    for batch in batches:
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is not None and ((file, start) != at or size > CHUNK_BYTES):
                yield at, held
                held, size = [], 0
            at = (file, start)
            held.append(value)
            size += len(value)
    if at is not None:
        yield at, held


# ---------------------------------------------------------------------------- states


def _csv_change(values: list[bytes]) -> tuple[int, int, int]:
    return sum(v.count(b'"') for v in values) & 1, 0, 0


_ESCAPE = re.compile(rb"\\.", re.DOTALL)


def _json_scan(values: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes with their closing braces, quotes passed up to each byte, and the step in depth of each byte."""
    raw = b"}".join([*values, b""])
    plain = _ESCAPE.sub(b"..", raw) if b"\\" in raw else raw
    b = np.frombuffer(plain, np.uint8)
    step = np.zeros(len(b), np.int8)
    step[(b == 123) | (b == 91)] = 1
    step[(b == 125) | (b == 93)] = -1
    return raw, np.cumsum(b == 34, dtype=np.int32), step


def _json_change(values: list[bytes]) -> tuple[int, int, int]:
    _, quotes, step = _json_scan(values)
    even = (quotes & 1) == 0
    return int(quotes[-1]) & 1 if len(quotes) else 0, int(step[even].sum()), int(step[~even].sum())


def _changes(change: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, (0, 0, 0)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "parity": pa.array([total[0]], pa.int32()),
                                               "outside": [total[1]], "inside": [total[2]]})
        for where, values in _chunks(batches):
            if where != at:
                if at is not None:
                    yield row()
                at, total = where, (0, 0, 0)
            p, out, inn = change(values)
            # a change that starts inside takes the other of the two steps
            total = (total[0] ^ p, total[1] + (inn if total[0] else out), total[2] + (out if total[0] else inn))
        if at is not None:
            yield row()
    return run


def _starts(ranges: DataFrame, change: Callable) -> dict[tuple[str, int], tuple[int, int]]:
    """(quote state, depth) at the start of every range that does not start as a file does.

    One small row per input split: no more than the driver already holds to schedule them.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.mapInArrow(_changes(change), STATE)
    quoted = rows.withColumn("q", F.pmod(F.coalesce(F.sum("parity").over(before), F.lit(0)), F.lit(2)))
    deep = quoted.withColumn("d", F.coalesce(F.sum(F.when(F.col("q") == 0, F.col("outside")).otherwise(F.col("inside"))).over(before), F.lit(0)))
    return {(r["file"], r["start"]): (r["q"], r["d"]) for r in deep.where("q <> 0 OR d <> 0").select("file", "start", "q", "d").collect()}


# ---------------------------------------------------------------------------- pieces


class _Out:
    """Rows of one range, numbered in order."""

    def __init__(self, where: tuple[str, int]):
        self.where, self.no, self.rows = where, 0, []

    def add(self, kind: str, text: bytes, key: str | None = None) -> None:
        self.rows.append((*self.where, self.no, kind, key, text))
        self.no += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 6
        self.rows = []
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(cols, types, strict=False)), pa.array(cols[5], pa.binary()).cast(pa.string())],
            ["file", "start", "no", "kind", "key", "text"])


class _CsvCutter:
    def __init__(self, where: tuple[str, int], quoted: int, depth: int):
        self.out, self.quoted, self.mine = _Out(where), quoted, not quoted
        self.open: list[bytes] = []

    def feed(self, values: list[bytes]) -> None:
        for line in values:
            self.open.append(line)
            self.quoted ^= line.count(b'"') & 1
            if not self.quoted:
                self.out.add("whole" if self.mine else "head", b"\n".join(self.open))
                self.open, self.mine = [], True

    def close(self) -> None:
        if self.open:
            self.out.add("tail" if self.mine else "mid", b"\n".join(self.open))


def _json_cutter(level: int):
    class Cutter:
        """Objects that open at depth ``level``, with the key of depth 1 that they stand under."""

        def __init__(self, where: tuple[str, int], quoted: int, depth: int):
            self.out, self.quoted, self.depth = _Out(where), quoted, depth
            self.inside, self.mine = depth > level, depth <= level
            self.key: str | None = None
            self.open: list[bytes] = []

        def feed(self, values: list[bytes]) -> None:
            raw, quotes, step = _json_scan(values)
            outside = ((quotes + self.quoted) & 1) == 0
            depth = self.depth + np.cumsum(np.where(outside, step, 0), dtype=np.int32)
            b = np.frombuffer(raw, np.uint8)
            before = np.concatenate([[self.depth], depth[:-1]])
            begins = np.flatnonzero((b == 123) & outside & (before == level))
            ends = np.flatnonzero((b == 125) & outside & (depth == level) & (before == level + 1))
            keys = self._keys(raw, quotes, outside, before) if level > 1 else []
            at, last = 0, 0
            for pos, is_end in sorted([*((int(p), False) for p in begins), *((int(p), True) for p in ends)]):
                while last < len(keys) and keys[last][0] < pos:
                    self.key = keys[last][1]
                    last += 1
                if is_end:
                    text = b"".join([*self.open, raw[at:pos + 1]])
                    self.out.add("whole" if self.mine else "head", text, self.key)
                    self.open, self.inside, self.mine = [], False, True
                else:
                    self.inside = True
                at = pos + (1 if is_end else 0)
            if self.inside:
                self.open.append(raw[at:])
            if last < len(keys):
                self.key = keys[-1][1]
            self.quoted = (self.quoted + int(quotes[-1])) & 1 if len(quotes) else self.quoted
            self.depth = int(depth[-1]) if len(depth) else self.depth

        def _keys(self, raw: bytes, quotes: np.ndarray, outside: np.ndarray, depth: np.ndarray) -> list[tuple[int, str]]:
            """(position, name) of the names at depth 1; a name and its colon never hold a brace."""
            found = []
            quote = np.flatnonzero(np.diff(quotes, prepend=0))
            for p in quote[~outside[quote] & (depth[quote] == 1)]:
                m = _NAME.match(raw, int(p))
                if m:
                    found.append((int(p), m[1].decode("utf-8", "replace")))
            return found

        def close(self) -> None:
            if self.inside and self.open:
                self.out.add("tail" if self.mine else "mid", b"".join(self.open), self.key)
            if self.key is not None:
                self.out.add("key", b"", self.key)
    return Cutter


_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:', re.DOTALL)


def _pieces(states: dict[tuple[str, int], tuple[int, int]], cutter: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for where, values in _chunks(batches):
            if cut is None or cut.out.where != where:
                if cut is not None:
                    cut.close()
                    yield cut.out.batch()
                cut = cutter(where, *states.get(where, (0, 0)))
            cut.feed(values)
            yield cut.out.batch()
        if cut is not None:
            cut.close()
            yield cut.out.batch()
    return run


def _records(spark: SparkSession, path: str, sep: str, change: Callable, cutter: type, joint: str) -> DataFrame:
    """(file, start, no, key, text) of every record, in the order of (file, start, no)."""
    ranges = _ranges(spark, path, sep)
    # written once: whole records and fragments are two readers of one costly pass
    rows = materialise(ranges.mapInArrow(_pieces(_starts(ranges, change), cutter), PIECE), "records")
    whole = rows.where("kind = 'whole'").select("file", "start", "no", "key", "text")
    parts = rows.where("kind IN ('head', 'mid', 'tail')")
    upto = Window.partitionBy("file").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, 0)
    # a record opens with its tail piece in the range where it begins; only the places are ordered
    named = parts.select("file", "start", "no", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(upto).alias("rec"))
    joined = parts.join(named, ["file", "start", "no"]).groupBy("file", "rec").agg(
        F.array_sort(F.collect_list(F.struct("start", "no", "key", "text"))).alias("p"))
    first = F.col("p")[0]
    stitched = joined.where("rec > 0").select("file", first["start"].alias("start"), first["no"].alias("no"), first["key"].alias("key"),
                                              F.array_join(F.transform("p", lambda x: x["text"]), joint).alias("text"))
    every = whole.unionByName(stitched)
    if sep == "\n":
        return every
    # the name that a range starts under is the last one seen before it
    names = rows.where("kind = 'key'").select("file", "start", "key")
    spans = rows.select("file", "start").distinct().join(names, ["file", "start"], "left")
    prior = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    under = spans.select("file", "start", F.last("key", ignorenulls=True).over(prior).alias("_under"))
    return every.join(under, ["file", "start"]).withColumn("key", F.coalesce("key", "_under")).drop("_under")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, no, text): every record of quoted CSV files, header records included."""
    return _records(spark, path, "\n", _csv_change, _CsvCutter, "\n").drop("key")


# stands for a comma between fields; U+FFFF is no character
_CUT = "￿"


def csv_fields(text):
    """Fields of one record: a pair of quotes inside quotes is one, and outside them a carriage return is nothing.

    Between quotes lie, in turn, text outside and inside; an empty text outside stands for a doubled quote.
    """
    def plain(parts):
        return F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).when(
            (p == "") & (i > 0) & (i < F.size(parts) - 1), F.lit('"')).otherwise(F.translate(p, ",\r", _CUT)))
    # bound by a one-element list, so that the text is split once and not once per part
    joined = F.transform(F.array(F.split(text, '"', -1)), lambda parts: F.array_join(plain(parts), ""))
    return F.split(joined[0], _CUT, -1)


def json_objects(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(file, start, no, text): every object of array files, or of the array ``member`` of object files.

    The array may stand on one line.  Elements that are no objects are passed over.
    """
    rows = _records(spark, path, "}", _json_change, _json_cutter(1 if member is None else 2), "")
    return (rows if member is None else rows.where(F.col("key") == member)).drop("key")
