"""op11 to op13 against plain code, and their defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradeloom.llm import divergence, topk_search, whitening
from gradeloom.llm.vectors import chunks

VECTORS = "vec_id long, embedding array<float>, label int, v string, Ids string, c string, g string, rank string, Score string"
INF, NAN = float("inf"), float("nan")


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, "v", "i", "c", "g", "r", "s") for i, e in rows], VECTORS)


def integer(e):
    return np.floor(64 * np.array(e, np.float32).astype(float)).astype(np.int64)


def usable(rows):
    return [(i, e) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]


def plain_top(rows, k, every):
    good = [(i, integer(e)) for i, e in usable(rows) if i is not None]
    width = max((len(x) for _, x in good), default=0)
    good = [(i, np.pad(x, (0, width - len(x)))) for i, x in good]
    asked = {}
    for i, x in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, x), x, key=tuple)
    out = []
    for q, x in asked.items():
        scores = sorted((-int(x @ y), i) for i, y in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def clustered(n, d, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    return [(i, [float(c) for c in centres[rng.integers(8)] + spread * rng.standard_normal(d)]) for i in range(n)]


ODD = [(None, [1.0] * 6), (40, None), (41, []), (60, [1.0, None, 1.0]), (61, [1.0, NAN, 0.0]), (62, [INF, 0.0]), (80, [0.5, -0.5]), (7, [1.0] * 6), (7, [1.0] * 6)]


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_all_pairs(spark, monkeypatch, small):
    if small:  # many blocks, groups of queries and cells, and pairs one by one
        for name, value in (("BLOCK_ROWS", 16), ("QUERY_CELL", 10), ("ROW_CELL", 40), ("QUERY_ROWS", 4), ("SPARSE", 0.5)):
            monkeypatch.setattr(topk_search, name, value)
    rows = clustered(300, 20, 1) + [(300 + i, [1.0] * 20) for i in range(60)] + [(i, [0.0] * 20) for i in (400, 401, 402)]
    got = topk_search.top_k(vectors(spark, rows), k=7, every=5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 7, 5)


def test_top_k_defined_cases(spark):
    rows = [*ODD, *((100 + i, [float(i % 3), 1.0]) for i in range(30)), (20, [2.0, 2.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])]
    assert sorted(map(tuple, topk_search.top_k(vectors(spark, rows), 5, 20).collect())) == plain_top(rows, 5, 20)
    few = [(0, [1.0]), (20, [2.0]), (3, [-1.0])]
    assert sorted(map(tuple, topk_search.top_k(vectors(spark, few), 20, 20).collect())) == plain_top(few, 20, 20)
    assert topk_search.top_k(vectors(spark, [(0, [1.0])]), 20, 20).collect() == []
    assert topk_search.top_k(vectors(spark, []), 20, 20).collect() == []


def test_top_k_scores_beyond_doubles_stay_exact(spark):
    rows = [(i, [2.0**22 + i, -(2.0**22) + 3 * i, 2.0**20, 1.0]) for i in range(40)]
    assert sorted(map(tuple, topk_search.top_k(vectors(spark, rows), 6, 10).collect())) == plain_top(rows, 6, 10)


def test_top_k_bounds_leave_most_pairs_out():
    rows = clustered(2048, 64, 5, 0.05)
    x = np.stack([integer(e) for _, e in rows])
    block = topk_search.Block(np.arange(2048).tobytes(), "<i8", [np.ascontiguousarray(x[:, i:i + 8].T).tobytes() for i in range(0, 64, 8)])
    scores = x[:32] @ x.T
    kth = np.sort(scores, axis=1)[:, -21].astype(float)
    followed = []
    best = topk_search.Best(2048, 20, np.concatenate([kth, np.full(2016, np.inf)]), np.int64)
    add = best.add
    best.add = lambda q, i, s: (followed.append(len(q)), add(q, i, s))
    topk_search._scan(block, block, 0, 32, best, np.float64)
    assert sum(followed) < 32 * 2048 * 0.02
    assert Counter(best.query.tolist()) == dict.fromkeys(range(32), 20)


def test_chunks_deal_rows_anew():
    import pyarrow as pa

    made = [pa.RecordBatch.from_pydict({"a": list(range(i, i + n))}) for i, n in ((0, 5), (5, 0), (5, 1), (6, 7))]
    got = [b.column(0).to_pylist() for b in chunks(iter(made), 4)]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12]]


def plain_whitening(rows, most=16):
    good = usable(rows)
    width = max((len(e) for _, e in good), default=0)
    x = np.array([np.pad(integer(e), (0, width - len(e))) + 1_000_000 for _, e in good]).reshape(len(good), width)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    a = (n * fit - total) / n
    e, c = np.linalg.eigh(a.T @ a / n)
    e, c = e[::-1][:most], c[:, ::-1][:, :most]
    keep = e > 1e-13 * e.max(initial=0)
    deviation = [sum(int(v) ** 2 for v in n * r - total) for r in x]
    return good, n, deviation, ((n * x - total) / n) @ (c[:, keep] / np.sqrt(e[keep])), e[keep] / np.trace(a.T @ a / n)


@pytest.mark.parametrize("copies", [0, 150])
def test_whitening_equals_plain_eigenvectors(spark, copies):
    rng = np.random.default_rng(2)
    scale = np.geomspace(4, 0.3, 24)
    rows = [(i, [float(v) for v in rng.standard_normal(24) * scale]) for i in range(250)]
    rows += [(1000 + i, rows[0][1]) for i in range(copies)] + [(2000, None), (2001, [NAN] * 24), (2002, [1.0, None])]
    good, n, deviation, want, explained = plain_whitening(rows)
    out = whitening.whitened(vectors(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = defaultdict(dict)
    for r in out.collect():
        got[r.vec_id][r.component] = r
        assert r.n == n == 250 and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert sorted(got) == sorted(i for i, _ in good)
    mine = np.array([[got[i][c].whitened for c in range(1, 17)] for i, _ in good])
    assert [got[i][1].deviation for i, _ in good] == deviation
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-7


def test_whitening_defined_cases(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    # equal variances, a constant dimension, a dependent one, short and repeated rows, a null id
    corners = [(float(a), float(b), float(c)) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    rows = [(i, [a, b, c, 0.5, a + b]) for i, (a, b, c) in enumerate(corners)] + [(None, list(corners[0]) + [0.5, -2.0]), (50, [1.0, 1.0])]
    good, n, deviation, want, explained = plain_whitening(rows)
    out = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.n for r in out} == {n} == {9}
    assert len(out) == len(good) * want.shape[1]
    assert max(r.identity_error for r in out) < 1e-9
    parts = {r.component: r.explained for r in out}
    assert np.allclose([parts[i + 1] for i in range(len(explained))], explained, rtol=1e-9)
    assert sorted(r.deviation for r in out if r.component == 1) == sorted(deviation)


def test_whitening_equal_variances(spark):
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(6)]) for i in range(6) for s in (0, 1)]
    out = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.component for r in out} == set(range(1, 7))
    assert max(r.identity_error for r in out) < 1e-9
    assert np.allclose([r.explained for r in out], 1 / 6)


def plain_divergence(rows, min_docs=3, top=200):
    lower = {i: i + 32 for i in range(65, 91)}
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        ts = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        df[lang].update(set(ts))
        counts[lang, source].update(ts)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def share(c, total, kept=kept):
            return 1 + 10**9 * (c + 1) // (total + len(kept))
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            words = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(sorted(words)[:top])]
    return sorted(out)


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, term string, df string, Sources string, shard string, item string"
    return spark.createDataFrame([(i, t, la, s, "a", "b", "c", "d", "e") for i, (la, s, t) in enumerate(rows)], schema)


@pytest.mark.parametrize("stripes,shard", [(120_000, 1 << 15), (40, 16)])
def test_divergence_equals_plain_counts(spark, monkeypatch, stripes, shard):
    monkeypatch.setattr(divergence, "STRIPES", stripes)
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Été", "straße", "İx", "日本", "a b", "\U0001f600"]
    rows = [("en" if rng.random() < 0.7 else "fr", f"s{rng.choice([0, 0, 0, 1, 2, 3])}", "-".join(
        rng.choice(words[:rng.randrange(5, 300)]).title() for _ in range(rng.randrange(40)))) for _ in range(250)]
    rows += [(None, None, "one two"), ("en", None, None), ("en", "quiet", "12 34 _"), ("xx", "a", "lonely"), ("xx", "b", ""), ("yy", "z", "zz zz zz")]
    rows += [("de", "hot", "gleich und gleich")] * 120 + [("de", "b", "gleich"), ("en", "s9", "long " * 60_000)]
    got = divergence.audit(documents(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)


def test_divergence_top_and_empty(spark):
    rows = [("en", s, " ".join(f"t{chr(97 + i)}{chr(97 + j)}" for j in range(26) for i in range(12))) for s in ("a", "a", "a")]
    rows += [("en", "b", "ta other")] * 3
    for top in (5, 200):
        assert sorted(map(tuple, divergence.audit(documents(spark, rows), top=top).collect())) == plain_divergence(rows, top=top)
    assert divergence.audit(documents(spark, [])).collect() == []
