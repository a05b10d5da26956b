"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes ``FEATURES`` transformed statistics.  Counts, sums and sums of products per
class are added up over all labelled training rows in Spark (some hundred numbers reach the
driver, whatever their number), so the fit uses every row.  A class covariance is shrunk towards
the pooled variances; its Cholesky factor is kept, and a score is the logistic of the difference
of the two Mahalanobis log densities plus the log prior.

Defined cases: null and empty texts have all statistics zero and are scored; a label counts once
per doc_id (its largest value); null labels are no labels; with a class missing, both classes take
the pooled moments, and without any label every score is the prior's 0.5; repeated rows are scored
each; columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as H
from gradeloom.session import materialise

FEATURES = ["log_words", "word_length", "symbols", "marks", "upper", "digits", "repeat_words", "repeat_windows", "distinct_words",
            "wide", "line_length", "stops", "short_words"]
SHRINK = 0.1
FLOOR = 1e-3
CUT = 0.3
FOLDS = 5

_ORD = np.arange(256)
_SYMBOL = np.isin(_ORD, np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@", np.uint8))
_MARK = np.isin(_ORD, np.frombuffer(b"!?", np.uint8))
_STOP = np.isin(_ORD, np.frombuffer(b".,;:", np.uint8))
_UPPER = (_ORD >= 0x41) & (_ORD <= 0x5A)
_DIGIT = (_ORD >= 0x30) & (_ORD <= 0x39)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text."""
    w, rows = H.Words(raw, offsets, H.SPACE), len(offsets) - 1
    n = w.count.astype(float)
    some = np.maximum(n, 1.0)
    length = np.bincount(w.row, w.end - w.begin, rows)
    chars = np.maximum(length, 1.0)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    g, _ = H.row_grams(w, 3)
    at = np.concatenate([[0], np.cumsum(np.maximum(w.count - 2, 0))])
    windows, words = np.zeros(rows), np.zeros(rows)
    for r in range(rows):
        own = g[at[r]:at[r + 1]]
        windows[r] = 1 - len(np.unique(own)) / len(own) if len(own) else 0.0
        mine = w.hash[w.first[r]:w.first[r] + w.count[r]]
        # vocabulary grows about as a power of the length, so its exponent is compared
        words[r] = np.log(len(np.unique(mine))) / np.log(len(mine)) if len(mine) > 1 else 1.0
    ratio = lambda flags: np.sqrt(_per_row(flags[raw], offsets) / chars)
    lines = _per_row(raw == 10, offsets) + 1
    short = np.bincount(w.row, (w.end - w.begin) <= 3, rows)
    wide = (raw >= 0x80).astype(float)
    out = np.stack([
        np.log1p(n), np.log1p(length / some), ratio(_SYMBOL), ratio(_MARK), ratio(_UPPER), ratio(_DIGIT),
        np.sqrt(np.bincount(w.row, same, rows) / some), np.sqrt(windows), np.where(n > 0, words, 0.0),
        np.sqrt(_per_row(wide, offsets) / chars), np.log1p(n / lines), ratio(_STOP), short / some], axis=1)
    out[n == 0] = 0.0
    return out


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of each row."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [statistics(raw, off) for _, _, raw, off in H.pieces(batch.column(1))]
            x = np.concatenate(made) if made else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(batches, f"doc_id {kind}, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


class Discriminant:
    """Two Gaussian classes with shrunk covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(FEATURES)
        empty = (0.0, np.zeros(d), np.zeros((d, d)))
        both = [moments.get(c, empty) for c in (0, 1)]
        n, s, q = (sum(m[i] for m in both) for i in range(3))
        self.known = n > 0
        if not self.known:
            return
        pooled = q / n - np.outer(s / n, s / n)
        self.parts = []
        for count, total, products in both:
            if count < 2:
                count, total, products = max(count, 0.5), s / n * max(count, 0.5), q / n * max(count, 0.5)
            mean = total / count
            own = products / count - np.outer(mean, mean)
            cov = (1 - SHRINK) * own + SHRINK * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(count)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        logs = [prior - half - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, half, prior in self.parts]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """Moments over all labelled rows outside the held-out fold."""
    d = len(FEATURES)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    train = features.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("quality", "x")

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in it:
            y = np.array(batch.column(0).to_pylist(), int)
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
            for c in (0, 1):
                own = x[(y > 0) == bool(c)]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        cls, at = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(at), pa.array(total.ravel())], ["cls", "at", "v"])
    flat = np.zeros((2, 1 + d + d * d))
    for cls, at, v in train.mapInArrow(sums, "cls bigint, at bigint, v double").groupBy("cls", "at").agg(F.sum("v")).collect():
        flat[cls, at] = v
    return Discriminant({c: (flat[c, 0], flat[c, 1:1 + d], flat[c, 1 + d:].reshape(d, d)) for c in (0, 1) if flat[c, 0]})


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    features = materialise(featured(docs), "quality-features")
    model = fit(features, labels)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])
    kind = features.schema["doc_id"].dataType.simpleString()
    out = features.mapInArrow(batches, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
