"""Segments of documents in pages: one result, wherever the pages were cut."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import segments
from gradeloom.plans import knowledge



def plain(text):
    found = list(re.finditer(r"MARK \d\d?:|END\s+OF", text))
    return [(i + 1, m.group(), text[m.end():found[i + 1].start() if i + 1 < len(found) else len(text)]) for i, m in enumerate(found)]


def streams(rng, n):
    """Documents of odd pages: markers cut anywhere, empty pages, pages of one letter."""
    out = {}
    for d in range(n):
        text = "".join(rng.choice(["MARK 1:", "MARK 23:", "END OF", "END\nOF", "a", "b c", "\n", " ", "x" * 30, "MARK ", "1:", "é"]) for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(25)))
        # a page ends where the stream has its joint, so only places after a line break are cut there; the rest gain one
        pages = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        out[f"d{d}"] = pages
    return out


@pytest.mark.parametrize("longest,joint", [(8, "\n"), (8, " "), (9, "\n"), (4096, " ")])
def test_stream_of_pages_equals_whole_text(spark, longest, joint):
    docs = streams(random.Random(longest), 40)
    rows = [(d, i * 3, p if p or i % 2 else None) for d, pages in docs.items() for i, p in enumerate(pages)]
    got = {}
    for r in segments.segment_pages(spark.createDataFrame(rows, "doc string, page_no int, text string"), r"MARK \d\d?:|END\s+OF", joint=joint, longest=longest).collect():
        got.setdefault(r["doc"], []).append((r["seg_no"], r["marker"], r["body"]))
    want = {d: plain(joint.join(pages)) for d, pages in docs.items()}
    assert {d: sorted(v) for d, v in got.items()} == {d: v for d, v in want.items() if v}


def test_parts_give_one_result(spark):
    words = ("alpha MARK 1: beta gamma delta epsilon MARK 2: " * 12).split(" ")
    pages = spark.createDataFrame([("d", i, w) for i, w in enumerate(words)] + [("e", 0, "MARK 7: only")], "doc string, page_no int, text string")
    rows = [sorted(map(tuple, segments.segment(segments.assemble_documents(pages, part_pages=n), r"MARK\s\d:").collect())) for n in (1, 2, 7, 1000)]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) == 25


def test_guide_and_prompt_over_a_seam(spark):
    guide = ("Intro Scoring Guide Score 6 A 6 response exhibits the following characteristics: 1. first text 2. second 3. third 4. fourth 5. fifth "
             "Score 1 A 1 has the following characteristics: 1. a 2. b 3. c 4. d Score 0 Off topic. Sample Responses with Reader and Scoring Guide again")
    topic = ("Sample Topic: People rely on tools. Discuss the extent to which you agree. GRE Scoring Guide "
             "The following sample response received a score of 6: Essay six. Comments on sample essay receiving score of 6: Good work.")
    whole = spark.createDataFrame([("g", guide), ("t", topic), ("n", "no guide"), ("o", "Scoring Guide that never ends")], "doc string, text string")
    words = [(d, i // n, " ".join(t.split()[i:i + n])) for n in (2, 5) for d, t in ((f"g{n}", guide), (f"t{n}", topic)) for i in range(0, len(t.split()), n)]
    cut = spark.createDataFrame(words, "doc string, part int, text string")
    flat = lambda df: sorted(map(str, (tuple(r)[1:] for r in df.collect())))
    expected = flat(knowledge.extract_rubric(whole))
    assert len(expected) == 10
    prompt = r"Sample Topic: (.*?) GRE Scoring Guide"
    anchors = lambda df: sorted((r["essay"], r["commentary"], r["statement"]) for r in knowledge.extract_anchors(df, prompt=prompt).collect())
    for n in (2, 5):
        part = cut.where(F.col("doc").endswith(str(n)))
        assert flat(knowledge.extract_rubric(part)) == expected
        assert anchors(part) == anchors(whole) == [("Essay six.", "Good work.", "People rely on tools.")]
