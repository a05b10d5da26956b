"""How far the sources of a language differ in their words, by in-mapper stripes.

A task folds whole documents into one stripe per (language, term): its document frequency and a
count per source.  When a task holds ``STRIPES`` of them it passes them on and starts anew, so
its memory has a bound; a frequent term costs one stripe per spill, however many rows hold it.
Stripes are dealt by (language, term) and merged; those in at least ``min_docs`` documents stay.

Merged stripes meet the totals of their language in shards of bounded size.  A task turns its
stripes into a (terms x sources) array, adds up all pairs of sources, and keeps the best terms
of each source; only sums and best terms are shuffled again.  All numbers are whole.

Per group: p = 1 + floor(10**9 * (count + 1) / (N + V)), f(p, q) = floor((p - q)**2 / q).

Defined cases: null text, language or source is the empty text; a text without terms still
makes its group; a language that keeps no term has pairs of value 0 and no terms; repeated rows
are documents each; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch

STRIPES = 120_000
SHARD_TERMS = 1 << 15
CELLS = 1 << 21  # numbers of one array in a task
ONE = 10**9
MIN_DOCS = 3
TOP = 200

# fixed values: terms are runs of a-z and of bytes above ASCII; only A-Z change case
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

STRIPE = "lang string, term string, df bigint, sources array<string>, counts array<bigint>"
PART = "lang string, source string, part string, item string, value bigint"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _stripes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[bytes, dict]] = {}
    n = 0

    def spill() -> pa.RecordBatch:
        langs, words, df, sources, counts, ends = [], [], [], [], [], [0]
        for lang, own in held.items():
            langs.extend([lang] * len(own))
            words.extend(own)
            for stripe in own.values():
                df.append(stripe.pop(None))
                sources.extend(stripe)
                counts.extend(stripe.values())
                ends.append(len(sources))
        offsets = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(df, pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], ["lang", "term", "df", "sources", "counts"])

    for batch in it:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = held.setdefault(lang, {})
            before = len(own)
            for term, count in Counter(terms(text.as_py())).items():
                stripe = own.get(term)
                if stripe is None:
                    own[term] = {None: 1, source: count}
                else:
                    stripe[None] += 1
                    stripe[source] = stripe.get(source, 0) + count
            n += len(own) - before
            if n >= STRIPES:
                yield spill()
                held, n = {}, 0
    if n:
        yield spill()


def stripes(docs: DataFrame) -> DataFrame:
    """Merged stripes (lang, term, df, sources, counts) of all terms."""
    parts = docs.mapInArrow(_stripes, STRIPE).repartition("lang", "term")
    # dealt once: both groupings below find their rows in place
    cells = parts.select("lang", "term", F.posexplode(F.arrays_zip("sources", "counts")).alias("i", "c"), "df")
    merged = cells.groupBy("lang", "term", F.col("c.sources").alias("source")).agg(
        F.sum("c.counts").alias("count"), F.sum(F.when(F.col("i") == 0, F.col("df"))).alias("df"))
    return merged.groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.collect_list(F.struct("source", "count")).alias("cells")).select(
        "lang", "term", "df", F.col("cells.source").alias("sources"), F.col("cells.count").alias("counts"))


def _share(count: np.ndarray, total, kinds: int) -> np.ndarray:
    return 1 + ONE * (count + 1) // (total + kinds)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _diverging(top: int):
    def run(key: tuple, found: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        names = groups.column("source").combine_chunks()
        totals = groups.column("n").to_numpy()
        kinds = groups.column("kinds")[0].as_py() if len(names) else 0
        found = found.sort_by("term")  # bytewise, so ties below fall to the smaller term
        big = ONE * (int(totals.sum()) + 1) >= 1 << 62
        kind = object if big else np.int64
        totals = totals.astype(kind)
        whole = totals.sum() if len(totals) else 0
        sums = np.zeros((len(names), len(names)), kind)
        word, own, value = [], [], []
        step = max(1, CELLS // max(1, len(names)))
        for lo in range(0, found.num_rows, step):
            part = found.slice(lo, step).combine_chunks()
            cells = part.column("sources").combine_chunks()
            lens = cells.value_lengths().to_numpy()
            counts = np.zeros((part.num_rows, len(names)), kind)
            at = pc.index_in(cells.flatten(), value_set=names).to_numpy()
            counts[np.repeat(np.arange(part.num_rows), lens), at] = part.column("counts").combine_chunks().flatten().to_numpy()
            p = _share(counts, totals[None, :], kinds)
            for t in range(len(names)):
                sums[:, t] += _gap(p, p[:, t:t + 1]).sum(axis=0)
            q = _share(counts.sum(axis=1), whole, kinds)
            for s in range(len(names)):
                rows = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
                f = _gap(p[rows, s], q[rows])
                best = np.argsort(-f, kind="stable")[:top]
                word.append(rows[best] + lo)
                own.append(np.full(len(best), s))
                value.append(f[best])
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        word, own, value = (np.concatenate([x, np.zeros(0, x[0].dtype if x else np.int64)]) if not x else np.concatenate(x) for x in (word, own, value))
        n, m = len(a), len(own)
        return pa.table({
            "lang": pa.array([lang] * (n + m), pa.string()),
            "source": pa.concat_arrays([names.take(pa.array(a)), names.take(pa.array(own.astype(np.int64)))]),
            "part": pa.array(["pair"] * n + ["term"] * m, pa.string()),
            "item": pa.concat_arrays([names.take(pa.array(b)), found.column("term").combine_chunks().take(pa.array(word.astype(np.int64)))]),
            "value": pa.array([*sums[a, b].tolist(), *value.tolist()], pa.int64()),
        })
    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and each source's ``top`` terms."""
    empty = F.lit("")
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    tables = Scratch(docs.sparkSession)
    kept = tables.put("stripes", stripes(plain.select("lang", "source", F.col("text").cast("binary").alias("text"))).where(F.col("df") >= min_docs))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy(
        "lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = tables.put("groups", plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(
        kinds, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit(0)).alias("kinds")))
    # a language has as many shards as its terms fill; each gets the totals of the language
    shards = lambda k: F.greatest(F.lit(1), F.ceil(k / SHARD_TERMS)).cast("int")
    left = kept.join(kinds, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), shards(F.col("kinds"))).cast("int")).drop("kinds")
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), shards(F.col("kinds")) - 1)))
    parts = tables.put("divergences", left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(_diverging(top), PART))
    tables.drop("stripes", "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    words = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(words)
