import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import html as H
from gradeloom.functions import rules as R
from gradeloom.operators import segments
from gradeloom.operators import threads as T
from gradeloom.plans import parsers
from gradeloom.schema import POST

WORDS = ("The author claims progress because people in my view agree and the statement suggests growth over time . "
         "In conclusion the argument rests on the evidence that communities share and repeat in every decade .")


def prose(paragraphs=4, repeat=3):
    return "\n\n".join(" ".join([WORDS] * repeat) for _ in range(paragraphs))


def test_demarkdown(col):
    assert col(T.demarkdown, ["# Head\n> quote *bold* [link](http://x) &amp; `c`\n---\nend​"]) == [
        "Head\nquote bold link & c\nend"] or col(T.demarkdown, ["**a** &AMP; b"]) == ["a & b"]


def test_restore_paragraphs(col):
    got = col(T.restore_paragraphs, ["First end.Second by Dr.Smith in the U.S.Army now.\"Quote\" stays", "has\nbreaks.Kept"])
    assert got == ["First end.\n\nSecond by Dr.Smith in the U.S.Army now.\n\n\"\n\nQuote\" stays", "has\nbreaks.Kept"]


def test_line_strippers(col):
    assert col(T.strip_junk_head, ["\n---\n(450 words)\nText starts.\n1"]) == ["Text starts.\n1"]
    assert col(T.strip_trailer, ["Essay body.\nThanks in advance!\n\n"]) == ["Essay body."]
    body = prose(3, 4)
    note = "Hi guys, please rate my first attempt"
    assert col(T.strip_preamble, [note + "\n" + body])[0].startswith("The author")
    assert col(T.strip_preamble, [note + "\nshort"])[0].startswith("Hi guys")
    got = col(T.strip_leading_instructions, ["My response:\nBe sure to explain your reasons. I think so.", "Essay: I disagree"])
    assert (got[0]["moved"], got[0]["rest"]) == ("Be sure to explain your reasons.", "I think so.") and got[1]["rest"] == "I disagree"


def test_own_score(spark):
    rows = [("Got a 4.5 on the AWA", ""), ("", "My tutor gave it 3/6 yesterday"), ("", "e-rater scored this 5/6"),
            ("", "official score report: AWA 5.0"), ("", "no numbers"), ("", "one stranger rated it 2 / 6")]
    df = spark.createDataFrame(rows, "t string, b string")
    got = [(r[0] and (r[0]["score"], r[0]["score_type"])) for r in df.select(T.own_score(F.col("t"), F.col("b"))).collect()]
    assert got == [(4.5, "third_party_rated"), (3.0, "teacher_rated"), (5.0, "estimated"), (5.0, "self_reported"), None, (2.0, "third_party_rated")]


def test_grader_comment(spark):
    rows = [("a", 0, "x", "I'd give this a 4", 2), ("a", 1, "y", "solid 5", 9), ("a", 2, "z", "I got 165 and a 6/6", 50), ("a", 3, "w", "probably 3", 9),
            ("b", 0, "x", "[deleted]", 5)]
    df = spark.createDataFrame(rows, "link string, pos int, author string, body string, score long")
    got = T.best_grader_comment(df).collect()
    assert [(r["link"], r["value"], r["author"]) for r in got] == [("a", 5.0, "y")]


def test_exam_or_practice(spark):
    df = spark.createDataFrame([(True, "on the real exam"), (False, "real exam"), (True, "home")], "h boolean, b string")
    assert [r[0] for r in df.select(T.exam_or_practice(F.col("h"), F.col("b"))).collect()] == ["real_exam_reported", "practice", "practice"]


LONG = " ".join(f"word{i}" for i in range(170))


@pytest.mark.parametrize("text,rule,prompt,essay_start", [
    ("Prompt: Cities should grow larger every single year.\nMy essay: " + LONG, "divider", "Cities should grow larger every single year.", "word0"),
    ("Cities grow. Write a response in which you agree. Be sure to explain why. " + LONG, "instruction",
     "Cities grow. Write a response in which you agree. Be sure to explain why.", "word0"),
    ("Topic: Cities grow.\n\n" + LONG, "label", "Cities grow.", "word0"),
    ('"' + "Quoted passage about cities and towns that is long enough to count as one prompt here" + '" ' + LONG, "leading_quote",
     "Quoted passage about cities and towns that is long enough to count as one prompt here", "word0"),
    ('The following memo says "a long statement about budgets and about towns and about roads and schools and parks here" ' + LONG, "closing_quote",
     'The following memo says "a long statement about budgets and about towns and about roads and schools and parks here"', "word0"),
    ("Fifteen words make this block long enough to be read as a prompt by the rule.\n\n" + LONG, "short_block",
     "Fifteen words make this block long enough to be read as a prompt by the rule.", "word0"),
    ("Just " + LONG, "none", "", "Just"),
])
def test_forum_split(col, text, rule, prompt, essay_start):
    got = col(T.split_forum_post, [text])[0]
    assert (got["rule"], got["prompt"]) == (rule, prompt) and got["essay"].startswith(essay_start)


def test_parse_threads(spark):
    threads = spark.createDataFrame([("u1", "My essay please", "http://f/my-essay-12.html", "7 Mar 2014"), ("u2", "AWA guide", "http://f/guide-13.html", None),
                                     ("u3", "No post", "http://f/x-14.html", None)], "thread_id string, title string, url string, date_text string")
    posts = spark.createDataFrame([("u1", 0, "GRE Bot", "Topic: Cities grow.\n\n" + LONG), ("u1", 1, "bob", "nice"), ("u1", 2, "eve", "I say 4.5/6"), ("u2", 0, "x", LONG)],
                                  "thread_id string, pos int, username string, body string")
    dates = spark.createDataFrame([("12", "2023-01-01")], "tid string, iso_date string")
    rows = parsers.parse_threads(threads, posts, dates).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["score"], r["score_type"], r["author_username"], r["publication_date"], r["human_authenticity"]) == (4.5, "third_party_rated", "bob", "2023-01-01", "likely")
    assert r["prompt_text"] == "Cities grow." and r["essay_id"].startswith("thread_my_essay_12_html_")
    assert parsers.parse_threads(threads, posts).first()["human_authenticity"] == "confirmed"


def test_parse_posts(spark):
    task = "Write a response in which you discuss the extent to which you agree. In developing and supporting your position, consider ways. "
    good = "Governments should fund science. " + task + "\n\n" + prose()
    rows = [("p1", "r", "ann", "GRE issue essay, rate it", good, 1400000000, "/p1", "flair", "q"), ("p1", "r", "ann", "GRE again", good, 1400000001, "/p1b", None, "q"),
            ("p2", "r", "bob", "GRE essay", "[removed]", 1, "/p2", None, "q"), ("p3", "r", "cy", "hello", good, 1700000000, "/p3", None, "q")]
    df = spark.createDataFrame(rows, POST).withColumn("ordinal", F.monotonically_increasing_id())
    comments = spark.createDataFrame([("p1", 0, "g", "I'd give this a 4", 3)], "link string, pos int, author string, body string, score long")
    got = parsers.parse_posts(df, comments, context=r"(?i)\bgre\b").collect()
    assert [r["essay_id"] for r in got] == ["post_p1"]
    r = got[0]
    assert r["essay_text"].startswith("The author claims") and r["prompt_text"].endswith("consider ways.") and r["source_url"] == "/p1"
    assert (r["score"], r["score_type"], r["human_authenticity"], r["publication_date"]) == (4.0, "third_party_rated", "confirmed", "2014-05-13")


def test_parse_pages(spark):
    html = (
        '<html><body><nav>menu</nav><article class="node node--essay"><div class="field--name-field-essaytitle"><div class="field__item">The following appeared in a memo from the mayor of a small town.</div></div>'
        '<div class="submitted">Submitted by ann_b on Fri, 03/07/2014 - 10:11</div><div class="node__content"><p>' + LONG + "<p>Second open paragraph here.<p>Average: 3</p></div>"
        '<div class="comment"><p>Scores by essay e-grader: 4.5 Out of 6</p></div><script>var x = "<p>no</p>";</script></article></body></html>')
    rows = [("https://archive.example/web/20200101000000id_/http://t.example/issue-essay/abc", 200, html), ("https://archive.example/web/2id_/http://t.example/b/c", 404, html), ("http://t.example/x", 200, html)]
    got = parsers.parse_pages(spark.createDataFrame(rows, "url string, status int, body string")).collect()
    assert len(got) == 1
    r = got[0]
    assert r["prompt_text"].startswith("The following appeared in a memo") and r["essay_text"] == LONG + "\n\nSecond open paragraph here."
    assert (r["author_username"], r["publication_date"], r["score"], r["score_type"], r["human_authenticity"], r["essay_type"]) == ("ann_b", "2014-03-07", 4.5, "estimated", "confirmed", "issue")


def test_parse_sections(spark):
    html = ("<article><h3>GRE Issue Essay Prompt 1: Towns</h3><h4>Prompt</h4><p>Towns grow.</p><h4>Instructions</h4><p>Discuss.</p><h4>Student Essay</h4><p>" + LONG
            + "</p><p>End.</p><h4>Essay Analysis</h4><p>Good. Score: 4.5</p><h4>Essay Analysis</h4><p>No pending essay. Score: 2</p></article>")
    blocks = parsers.heading_blocks(spark.createDataFrame([("http://m.example/gre/post/", 200, html)], "url string, status int, body string"))
    got = parsers.parse_sections(blocks).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["score"], r["prompt_text"], r["prompt_category"]) == (4.5, "Towns grow.\n\nDiscuss.", "GRE Issue Essay Prompt 1: Towns") and r["essay_text"].endswith("End.")


def test_parse_scored_documents(spark):
    text = "Intro Essay Response - Score 6\n" + LONG + "\n- 3 -\nRater Commentary for Essay Response - Score 6 good. Essay Response - Score 5\nshort one"
    got = parsers.parse_scored_documents(spark.createDataFrame([("d", text)], "doc string, text string")).collect()
    assert [(r["essay_id"], r["score"], r["essay_text"]) for r in got] == [("official_d_1_score6", 6.0, LONG)]


def test_parse_csv_corpus(spark):
    rows = [("gre_1", "Cities grow. Do you agree or disagree?", LONG, "high"), ("toefl_1", "p", LONG, "low"), ("gre_2", "p", "short", "")]
    got = parsers.parse_csv_corpus(spark.createDataFrame(rows, "id string, prompt string, text string, score_level string")).collect()
    assert [(r["essay_type"], r["notes"], r["score_available"]) for r in got] == [("issue", "proficiency_level: high", False)]


def test_url_helpers(col):
    assert col(H.canonical_url, ["http://h.example:80/a/b/", "http://h.example/a/b?x=1", "http://h.example/a"]) == ["https://h.example/a/b", None, None]
    assert col(H.section_score, ["Score: 4.5 overall", "none"]) == [4.5, None]


def test_zip_criteria(spark):
    df = spark.createDataFrame([(["a", "b"], ["1", "2", "3"]), ([], ["1"])], "x array<string>, y array<string>")
    assert [len(r[0]) for r in df.select(segments.zip_criteria(F.col("x"), F.col("y"))).collect()] == [2, 0]
    assert json.dumps([list(r[0]) for r in df.select(segments.numbered_items(F.lit("1. a 2. b c"))).collect()][0]) == '["a", "b c"]'


def test_leading_run_repeats_until_stable(spark):
    texts = ["Essay\n\nPrompt:\nWrite a response in which you agree. Be sure to explain why! My view is plain.\nEnd.",
             "Be sure to explain it\n\nBody.", "Discuss what questions", "No label here. Be sure to explain later.", None, "", "Response:\n"]
    got = [r and (r["moved"], r["rest"]) for r in (x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(
        T.strip_leading_instructions(F.col("t"))).collect())]
    assert got[0] == ("Write a response in which you agree. Be sure to explain why!", "My view is plain.\nEnd.")
    assert got[1] == ("Be sure to explain it", "Body.") and got[2] == ("Discuss what questions", "")
    assert got[3] == ("", texts[3]) and got[4][1] is None and got[5] == ("", "") and got[6] == ("", "")


def test_inline_span_keeps_its_block(spark):
    page = "<h3><span>Prompt 1</span></h3><p>Hello <span>important</span> ﬁne tail</p>"
    got = spark.createDataFrame([(page,)], "h string").select(H.html_blocks("h").alias("b")).first()["b"]
    assert [(b["tag"], b["text"]) for b in got] == [("h3", "Prompt 1"), ("p", "Hello important fine tail")]


def tree_of(spark, page, build):
    return spark.createDataFrame([(page,)], "h string").select(H.html_tree("h").alias("t")).select(build(F.col("t")).alias("r")).first()["r"]


def test_essay_node_comes_first(spark):
    essay = lambda t: F.transform(H.essay_blocks(t), lambda b: b["text"])
    page = ("<title>T</title><nav class='menu'><p>Menu</p></nav><div class='block outer'><div class='node teaser'><p>Teaser</p></div>"
            "<article class='x node--essay y'><h1>Head</h1><div class='node__content'><p>One</p><div class='links'><p>Share</p></div><p>Two <b>bold</b></p>"
            "<form><p>Login</p></form><div class='comment-wrapper'><p>Comment</p></div><p>Three</div><footer><p>Foot of node</p></footer></article>"
            "<aside><p>Aside</p></aside></div><footer><p>Footer</p></footer>")
    assert tree_of(spark, page, essay) == ["One", "Two bold", "Three"]
    assert tree_of(spark, page.replace("node__content", "other"), essay) == ["Head", "One", "Two bold", "Three", "Foot of node"]
    assert tree_of(spark, page.replace("node--essay", "none"), essay) == ["Teaser"]
    assert tree_of(spark, "<div class='nodes'><p>a</p></div><p>b</p><div class='block'><p>c</p></div>", essay) == ["a", "b"]
    assert tree_of(spark, "<div class='l-content'><p>open", essay) == ["open"]
    assert tree_of(spark, "", essay) == [] and tree_of(spark, None, essay) is None


def test_article_scope(spark):
    article = lambda t: F.transform(H.article_blocks(t), lambda b: F.concat(b["tag"], F.lit(":"), b["text"]))
    inner = "<h2>Prompt 1</h2><p>text</p><aside><p>aside</p></aside><nav><li>menu</li></nav><ul><li>item</li></ul>"
    expected = ["h2:Prompt 1", "p:text", "li:item"]
    assert tree_of(spark, f"<main><p>before</p><article>{inner}</article></main><p>after</p>", article) == expected
    assert tree_of(spark, f"<main><div class='big entry-content'>{inner}</div><p>after</p></main>", article) == expected
    assert tree_of(spark, f"<p>before</p><main>{inner}</main>", article) == expected
    assert tree_of(spark, f"<form><p>f</p></form>{inner}", article) == expected


def test_position_of_the_match_not_of_its_text(spark):
    text = "score 45 by nobody " + "x" * 300 + " score 4 by e-rater"
    got = spark.createDataFrame([(text,)], "t string").select("t", T.first_score(F.col("t"), [r"score (\d)\b"]).alias("h")).select(
        "h.*", T.context_of(F.col("t"), F.col("h"), 5, 11).alias("c")).first()
    assert (got["at"], got["c"]) == (text.index("score 4 by") + 1, "xxxx score 4 by e-rater")


def test_provenance_texts(spark):
    replies = spark.createDataFrame([("t", 1, "thanks"), ("t", 2, "a b " * 60 + "I would give this 4.5/6 overall"), ("t", 3, "3/6")], "thread_id string, pos int, body string")
    r = T.first_scored_reply(replies, score_rx=r"(\d(?:\.\d)?)\s*/\s*6", machine="robot").first()
    assert (r["score"], r["pos"], r["score_type"]) == (4.5, 2, "third_party_rated")
    assert r["evidence"].startswith("Rated in the thread") and "I would give this 4.5/6 overall..." in r["evidence"] and len(r["evidence"]) < 330
    posts = spark.createDataFrame([("p", None, None, None), ("q", 5.0, "self_reported", "own words")], "id string, score double, score_type string, evidence string")
    graded = spark.createDataFrame([("p", 4.0, "ann", "a solid 4"), ("q", 2.0, "bob", "a 2")], "link string, value double, author string, context string")
    got = {x["id"]: x["evidence"] for x in T.fill_from_comments(posts, graded).collect()}
    assert "(ann)" in got["p"] and "a solid 4" in got["p"] and got["q"] == "own words"
    note = spark.createDataFrame([("2014-01-02", "ann"), ("2024-01-02", "ann"), (None, None)], "d string, a string").select(R.authorship_note(F.col("d"), F.col("a")).alias("n"))
    texts = [x["n"] for x in note.collect()]
    assert "by ann" in texts[0] and "cannot be ruled out" in texts[1] and "no date" in texts[2]
    dates = spark.createDataFrame([("7 Mar 2014",), ("7 Mar 2999",)], "t string").select(R.forum_date(F.col("t")).alias("d"), R.forum_date(F.col("t"), "2010-01-01").alias("e"))
    assert [tuple(x) for x in dates.collect()] == [("2014-03-07", None), (None, None)]
