import re

from gradeloom.operators import checks


def test_short_heads_leak_as_contains_says(spark):
    texts = ["the shortword of it", "alpha beta gamma", "xalpha betay", "alphabet a", "éa b\tc", "a  b", "", None, "alpha\nbeta", "one two three four"]
    heads = ["word", "alpha beta", "a b", "a", "é", "b", "two three", "one two three four", "a beta", "", "  alpha   beta ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(heads)), "item_id long, passage string")
    got = checks.leaked_heads_across(docs, "doc_id", "text", items, "item_id", "passage").collect()
    plain = {i: " ".join(re.findall(r"\S+", h)) for i, h in enumerate(heads) if h is not None}
    want = {(d, i) for d, t in enumerate(texts) for i, h in plain.items() if t is not None and h in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    some = items.where("item_id = 0")
    assert [tuple(r) for r in checks.leaked_heads_across(docs, "doc_id", "text", some, "item_id", "passage").collect()] == [(0, 0)]
