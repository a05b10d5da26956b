from pyspark.sql import functions as F

from gradeloom.functions import signals as S

STATEMENT = (
    "As people rely more and more on technology to solve problems, the ability of humans to think for themselves "
    "will surely deteriorate.")


def run(spark, *essays):
    df = spark.createDataFrame([(i, e, STATEMENT) for i, e in enumerate(essays)], "id int, essay string, statement string")
    out = S.with_signals(df).orderBy("id")
    return [r["signals"] for r in out.collect()]


def test_counts_and_spread(spark):
    a, b, c = run(
        spark, "Technology helps us. It also hurts us.\n\nBut context matters a great deal here.",
        "Aaa bbb ccc ddd. Eee fff ggg hhh. Iii jjj kkk lll.",
        "No. Technology has repeatedly expanded the range of problems that ordinary people are able to reason about. It helps.")
    assert (a.word_count, a.paragraph_count, a.sentence_count) == (14, 2, 3)
    assert b.sentence_length_stdev == 0 and c.sentence_length_stdev > 5


def test_topic_flags(spark):
    off, on = run(
        spark,
        "My favourite recipe is a slow braised beef stew. Brown the meat first, then add carrots, onions and celery. "
        "Simmer for three hours until the meat falls apart. Serve with mashed potato and a glass of red wine. This dish "
        "is best made the day before, because the flavours deepen overnight in the refrigerator.",
        "Technology does not erode our ability to think; it changes what we think about. Humans who rely on calculators "
        "still reason about which computation to perform. The problems people solve today are more abstract than those "
        "solved by hand a century ago, which suggests the ability to think has been redirected rather than diminished.")
    assert "off_topic" in off.flags and "off_topic" not in on.flags and on.prompt_overlap > 0.15


def test_restating_markers_specificity(spark):
    echo, plain, yetis, wright = run(
        spark, "As people rely more on technology to solve problems, the ability of humans to think for themselves will deteriorate. I agree.",
        "Calculators made it cheap. However, critics argue. Admittedly, firstly it matters.",
        "Researchers studied yetis and thoroughness in reasoning.",
        "Machines changed everything. The Wright brothers flew in 1903. Boeing sold 5 percent later to Lockheed.")
    assert echo.opens_by_restating_prompt and not plain.opens_by_restating_prompt
    assert plain.concession_markers == ["however", "admittedly", "critics"] and plain.formulaic_markers == ["firstly"]
    assert yetis.concession_markers == []
    assert wright.specificity_markers == ["Wright", "Lockheed", "1903", "5 percent"]


def test_specificity_cap(spark):
    names = " ".join("Name" + chr(97 + i) + chr(97 + j) for i in range(6) for j in range(6))
    (s,) = run(spark, "Start " + names + ".")
    assert len(s.specificity_markers) == 25


def test_mechanical_zero(spark):
    df = spark.createDataFrame(
        [(0, "   \n  ", STATEMENT), (1, STATEMENT, STATEMENT), (2, "I disagree. Technology frees attention.", STATEMENT)],
        "id int, essay string, statement string")
    got = S.with_signals(df).orderBy("id").select(S.is_mechanical_zero(F.col("signals.flags"))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_rendered_lines(spark):
    df = spark.createDataFrame([("Technology helps us. It hurts.", STATEMENT)], "essay string, statement string")
    text = S.with_signals(df).select(S.render_signals()).first()[0].split("\n")
    assert text[0] == "Length: 5 words, 1 paragraph(s), 2 sentences."
    assert text[1] == "Sentence length: mean 2.5 words, standard deviation 0.7."
    assert text[4].endswith("none found.") and text[-1] == "Mechanical flags: extremely_short."


def test_flags_alone_compute_no_other_signal(spark):
    """A job that reads the flags pays for no markers; one that reads all of them computes each once."""
    df = spark.createDataFrame([("An  Essay\nwords", "an essay words and more"), (None, None), ("Σ", "σ"), ("in part", "In  part")], "essay string, statement string")
    out = S.with_signals(df)
    zero = out.select(S.is_mechanical_zero(F.col("signals.flags")).alias("zero"))
    plan = zero._jdf.queryExecution().optimizedPlan().toString()
    assert "million" not in plan and "copies_prompt" in plan
    assert out.where(S.is_mechanical_zero(F.col("signals.flags"))).select("signals")._jdf.queryExecution().optimizedPlan().toString().count("million") == 1
    assert [r[0] for r in zero.collect()] == [r["zero"] for r in out.withColumn("zero", S.is_mechanical_zero(F.col("signals.flags"))).collect()] == [True, True, True, True]
