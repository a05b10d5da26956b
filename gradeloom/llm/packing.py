"""Best-fit packing planned over a length histogram.

Documents are cut into pieces of at most ``capacity`` tokens.  Only the number of pieces of
each length goes to the driver (at most ``capacity`` rows).  Best fit decreasing then places
counts, not documents: bins that look alike are one group, and as many equal pieces as fit go
into a whole group at once.  The plan is rows (length, lo, hi, first sequence, pieces per
sequence, first offset); a piece of that length takes its place by its rank.  Each placement
halves a group's room at least and a length splits at most two groups, so the plan has at most
about 11 * 5 * ``capacity`` rows whatever the corpus is.

Ranks inside a length are cut into pieces, so a length that a third of all documents have is
spread over tasks.  Token ids come from a public tokenizer file; words are remembered per
worker, up to ``CACHE_WORDS``, because the tokenizer encodes each word by itself.

Defined cases: null or empty text has just the end id; repeated rows are pieces of their own;
a null doc_id is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.ranks import rank_in_key
from gradeloom.session import materialise

CAPACITY = 2048
END = (0).to_bytes(4, "little")
CACHE_WORDS = 600_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _classes() -> tuple[str, str]:
    letters = [c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L"]
    numbers = [c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N"]
    return "".join(letters), "".join(numbers)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in prints else next(spare)) for b in range(256)}


class WordTokenizer:
    """Ids of a text as little-endian 32-bit bytes, equal to encoding the whole text.

    The vocabulary lower-cases a text, cuts it at white space and other fixed borders and
    encodes each part by itself.  Texts of Latin letters are split at white space here, each
    different word is encoded once and then looked up; any other text, and one that could
    hold a special token, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters, numbers = _classes()
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")
        # beyond the Latin blocks; controls that Python takes for white space; special tokens
        self.other = re.compile("[^\x00-\u024f]|[\x1c-\x1f]|<\\|")
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        out = []
        for part in self.parts.findall(word):
            out.extend(t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters)))
        return b"".join([i.to_bytes(4, "little") for i in out])

    def __call__(self, text: str) -> bytes:
        if self.other.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        words, known = text.lower().split(), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: its place, length and checksum."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordTokenizer(path)
        for batch in it:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for col, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(batches, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(rows (length, lo, hi, first sequence, pieces per sequence, first offset), sequences)."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: list[tuple[int, int, int]] = []  # (free tokens, first sequence, sequences), sorted
    made = 0

    def fill(length: int, done: int, free: int, first: int, bins: int, left: int) -> int:
        """Place up to ``left`` pieces into a group of like bins; returns how many went in."""
        per = free // length
        whole = min(bins, left // per)
        if whole:
            rows.append((length, done, done + whole * per, first, per, capacity - free))
            keep(free - per * length, first, whole)
        rest = left - whole * per if whole < bins else 0
        if rest:
            rows.append((length, done + whole * per, done + whole * per + rest, first + whole, rest, capacity - free))
            keep(free - rest * length, first + whole, 1)
            whole, extra = whole + 1, rest
        else:
            extra = 0
        if whole < bins:
            keep(free, first + whole, bins - whole)
        return (whole - bool(extra)) * per + extra

    def keep(free: int, first: int, bins: int) -> None:
        if free:
            insort(room, (free, first, bins))

    for length in sorted(histogram, reverse=True):
        done, count = 0, histogram[length]
        while done < count:
            at = bisect_left(room, (length, -1, -1))
            if at < len(room):
                free, first, bins = room.pop(at)
            else:
                per = capacity // length
                free, first, bins = capacity, made, -(-(count - done) // per)
                made += bins
            done += fill(length, done, free, first, bins, count - done)
    return rows, made


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialise(tokenised(docs, path, capacity), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows, _ = plan(histogram, capacity)
    ranked = rank_in_key(pieces, ["length"], F.struct("doc_id", "piece"), ["doc_id", "piece", "ids_crc32"],
                         max(histogram.values(), default=0))
    slots = spark.createDataFrame(rows, "slot_length bigint, lo bigint, hi bigint, first bigint, per bigint, at bigint")
    place = F.col("rank") - F.col("lo")
    # the plan is bounded by the capacity alone, so sending it to every task is safe
    return ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(place / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("per")) * F.col("length")).cast("bigint").alias("offset"))
