import hashlib

import numpy as np
from pyspark.sql import functions as F

from gradeloom.functions import html as H
from gradeloom.functions import numbers as N
from gradeloom.functions import rules as R
from gradeloom.functions import sketch as K
from gradeloom.functions import text as X
from gradeloom.operators import dedup


def test_clean_text_unicode(col):
    raw = "“Quoted” it’s – a — b\r\nline  two \r\n\r\n\r\n\r\nﬁn  x "
    assert col(X.clean_text, [raw]) == ['"Quoted" it\'s - a -- b\nline two\n\nfin x']


def test_norm_key_accents_end_a_token(col):
    assert col(X.norm_key, ["Éa b!", "日本", "ﬁne"]) == ["e a b", "", "fine"]


def test_tokenisers_differ(col):
    t = ["Don't stop-gap 42x  é"]
    assert col(X.word_count, t) == [4]
    assert col(X.signal_words, t) == [["don't", "stop-gap", "x"]]
    assert col(X.space_words, t) == [["Don't", "stop-gap", "42x", "é"]]
    assert col(lambda c: F.size(X.space_words(c)), ["  "]) == [0]


def test_slug_id_keeps_hash_of_whole_slug(col):
    slug = "Issue/" + "a" * 90 + "-1"
    got = col(lambda c: X.essay_slug_id("p", c), [slug])[0]
    assert got.endswith(hashlib.sha1(slug.encode()).hexdigest()[:8])
    assert len(got) == 2 + 70 + 1 + 8


def test_fold_and_page_lines(col):
    assert col(X.fold_typography, ["a… •b—c  d"]) == ["a... b--c d"]
    assert col(X.drop_page_number_lines, ["x\n- 17 -\n 3 \nScore 6"]) == ["x\nScore 6"]


def test_first_sentences_and_noise(col):
    assert col(lambda c: X.first_sentences(c, 2), ["One. Two. Three."]) == ["One. Two."]
    assert col(X.strip_noise, ["- 3 -\nwrapped\n line \n12\nGRE General\nLT12-x\nend"]) == ["wrapped line end"]
    assert col(X.cut_trailer, ["body text  Copyright © 2010 by ETS. rest\nmore"]) == ["body text"]


def test_sentences_and_paragraphs(col):
    t = "Technology helps us. It also hurts us.\n\nBut context matters a great deal here."
    assert col(lambda c: F.size(X.sentences(c)), [t, 'He said "no." Then left! 42.']) == [3, 2]
    assert col(lambda c: F.size(X.paragraphs(c)), [t, "a\nb\nc", "one"]) == [2, 3, 1]
    assert col(X.blank_line_paragraph_count, [t, "one"]) == [2, None]


def test_shingles_short_and_empty(col):
    assert col(X.shingles, ["a b c", "", "a b c d e f"]) == [["a b c"], [], ["a b c d e", "b c d e f"]]


def test_keys_need_no_python_and_follow_every_compatibility_form(spark):
    import random
    import re
    import unicodedata
    rng = random.Random(7)
    points = [chr(c) for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1F200))]
    texts = ["".join(points[i:i + 40]) for i in range(0, len(points), 40)] + [
        "".join(rng.choice(points if rng.random() < 0.3 else "abc d9.") for _ in range(60)) for _ in range(300)] + ["", None, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("v", X.norm_key(F.col("v")).alias("k"), F.lower("v").alias("low"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r["k"] == re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", r["low"] or "")).strip(" ")


def test_signatures_of_a_batch_hold_little_memory():
    import tracemalloc

    import pyarrow as pa
    lists = [[], None, [5], list(range(3000)), *[[int(x) for x in np.arange(400) * (i + 1)] for i in range(3000)], []]
    given = pa.array(lists, pa.list_(pa.int64()))
    tracemalloc.start()
    got = K.minhash.func(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(got) == len(lists)
    assert got[0].as_py() == got[1].as_py() == got[-1].as_py() == [0] * K.NUM_HASHES
    mult, offset = K._multipliers(K.NUM_HASHES)
    for i in (2, 3, 4, 2500):
        h = np.array(lists[i], dtype=np.int64).view(np.uint64)
        want = [int(((h * m + o) >> np.uint64(32)).min().astype(np.uint32).view(np.int32)) for m, o in zip(mult, offset, strict=True)]
        assert got[i].as_py() == want


def test_page_trees_are_made_a_few_pages_at_a_time(spark):
    import pandas as pd
    pages = [None if i == 7 else f"<article class='a'><p>page {i}</p></article>" for i in range(300)]
    some = list(H.html_tree.func(iter([pd.Series(pages, dtype=object), pd.Series([], dtype=object)])))
    assert max(map(len, some)) <= H.SLICE_PAGES and sum(map(len, some)) == 300
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").coalesce(1)
    rows = {r["i"]: r for r in df.select("i", H.html_tree("h").alias("t"), H.html_blocks("h").alias("b")).collect()}
    assert all(rows[i]["t"]["blocks"][0]["text"] == rows[i]["b"][0]["text"] == f"page {i}" for i in range(300) if i != 7)
    assert rows[7]["b"] is None and rows[7]["t"]["blocks"] is None


def test_minhash_estimates_jaccard(spark):
    base = [f"w{i}" for i in range(400)]
    other = base[:380] + [f"z{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base)), (4, "")], "id int, t string")
    sig = {r["id"]: r["s"] for r in dedup.sketches(df, "id", "t", unicode=False).select("id", F.col("sig").alias("s")).collect()}
    assert len(sig[1]) == 96 and sig[1] == sig[3] and set(sig[4]) == {0}
    exact = 376 / (396 * 2 - 376)
    assert abs(np.mean([a == b for a, b in zip(sig[1], sig[2], strict=True)]) - exact) < 0.15
    est = spark.createDataFrame([(sig[1], sig[1], [])], "a array<int>, b array<int>, c array<int>")
    r = est.select(K.jaccard_estimate(F.col("a"), F.col("b")), K.jaccard_estimate(F.col("a"), F.col("c"))).first()
    assert r[0] == 1.0 and r[1] == 0.0


def test_rounding_and_medians(spark):
    df = spark.createDataFrame([(-0.8125,), (0.8125,)], "v double")
    assert [r[0] for r in df.select(N.round_up_half(F.col("v"), 3)).collect()] == [-0.812, 0.813]
    one = spark.createDataFrame([([4.0, 5.0, 5.0],), ([4.0, 4.5],), ([3.0, 6.0],)], "s array<double>")
    assert [r[0] for r in one.select(N.half_point_median(F.col("s"))).collect()] == [5.0, 4.5, 4.5]
    nums = spark.createDataFrame([(i,) for i in [1, 2, 3, 4]], "x int")
    assert nums.agg(N.upper_median("x")).first()[0] == 3


def test_variant_rules_and_split(col):
    assert col(R.classify_variant, [
        "discuss which view more closely aligns with", "extent to which you agree or disagree with the statement", "nothing"]) == [
        "two_views", "statement", None]
    text = "Statement here.\nWrite a response in which you\ndiscuss  it."
    got = col(lambda c: R.split_prompt(c, R.OPENER_GOLD), [text])[0]
    assert got["statement"] == "Statement here." and got["instruction"] == "Write a response in which you discuss it."
    assert col(R.domain_of, ["Universities should", "Zebras run"]) == ["education", "general"]


def test_classify_task(spark):
    df = spark.createDataFrame([
        ("The following is a letter from the mayor", "", ""), ("", "I strongly agree that in my opinion", ""),
        ("", "assumes that", "my issue essay"), ("", "", "")], "p string, e string, t string")
    got = [r[0] for r in df.select(R.classify_task(F.col("p"), F.col("e"), F.col("t"))).collect()]
    assert got == ["argument", "issue", "issue", "unknown"]


def test_dates(col, spark):
    assert col(R.iso_date_from_text, ["09/14/2019", "07 March 2014", "March 7, 2014", "Foo 3, 2001"]) == [
        "2019-09-14", "2014-03-07", "2014-03-07", None]
    assert col(lambda c: R.forum_date(c, "2020-01-01"), ["7 Mar 2014 10:00", "1 Jan 2020", "x"]) == ["2014-03-07", None, None]
    assert spark.range(1).select(R.epoch_date(F.lit(1669766400))).first()[0] == "2022-11-30"


def test_a_key_lowers_its_text_once(spark):
    from pyspark.sql import functions as F

    from gradeloom.functions import text as X
    plan = spark.range(1).select(X.norm_key(F.col("id").cast("string")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
