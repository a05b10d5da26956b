"""Main text of pages whose articles and side blocks have many shapes."""

import random

import pytest

from gradeloom.llm import html_blocks

SENTENCE = "Zaha orelin thenta inwhor est."
INSIDE = ["<ul><li>@</li></ul>", "<ol><li>@</li></ol>", "<section>@</section>", "<section><p>@</p></section>", "<dl><dd>@</dd></dl>",
          "<blockquote>@</blockquote>", "<table><tr><td>@</td></tr></table>", "<figure><figcaption>@</figcaption></figure>", "<h2>@</h2>", "<pre>@</pre>",
          '<p class="lead">@</p>', '<p class="share-of-market">@</p>', '<p class="side-effects">@</p>', '<p class="comment-free">@</p>',
          '<p class="ads-free">@</p>']
OUTSIDE = ['<div id="disqus_thread"><p>@</p></div>', '<div class="teaser">@</div>', '<div class="comments"><p>@</p></div>', "<aside><p>@</p></aside>",
           "<form><p>@</p></form>", "<div><p>@</p></div>", '<div class="cookie-notice">@</div>']


def page(i, open_tag="<article>", close_tag="</article>", extra="", after=""):
    rng = random.Random(i)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    parts = [f"Head {i} {say(4)}", *[f"{say(rng.randrange(5, 60))}." for _ in range(rng.randrange(1, 9))]]
    body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
    menu = "".join(f'<li><a href="/{k}">{say(1)}</a></li>' for k in range(4))
    return (f"<html><head><title>{parts[0]}</title></head><body><nav><ul>{menu}</ul></nav><div class=\"ad\">{say(7)}.</div>"
            f"{open_tag}{body}{extra}{close_tag}{after}<footer>&copy; {say(5)}.</footer></body></html>"), "\n\n".join(parts)


def texts(model, pages):
    found = [html_blocks.blocks(p) for p in pages]
    return [html_blocks.main_text(f, s) for f, s in zip(found, html_blocks.labelled(model, found), strict=True)]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, H string, least string")


@pytest.fixture(scope="module")
def model(spark):
    return html_blocks.trained(table(spark, [(i, "u", page(i)[0], "x", "y") for i in range(130)]))


@pytest.mark.parametrize("shape", INSIDE)
def test_blocks_of_an_article_stay(model, shape):
    made = [page(i, extra=shape.replace("@", SENTENCE)) for i in range(200, 240)]
    assert texts(model, [h for h, _ in made]) == [f"{t}\n\n{SENTENCE}" for _, t in made]


@pytest.mark.parametrize("shape", OUTSIDE)
def test_blocks_beside_an_article_go(model, shape):
    made = [page(i, after=shape.replace("@", SENTENCE)) for i in range(200, 240)]
    assert texts(model, [h for h, _ in made]) == [t for _, t in made]


@pytest.mark.parametrize("tag", ["<div>", '<div class="body-x">', "<section>"])
def test_pages_without_article_tags(spark, tag):
    made = [page(i, tag, "</div>" if "div" in tag else "</section>") for i in range(130)]
    got = {r.page_id: r.text for r in html_blocks.extracted(table(spark, [(i, "u", h, None, None) for i, (h, _) in enumerate(made)])).collect()}
    assert [got[i] for i in range(130)] == [t for _, t in made]


def test_repeated_and_long_pages(spark):
    made = [page(i) for i in range(60)]
    long_html, long_text = page(7, extra=f"<p>{'very long text. ' * 20_000}</p>")
    rows = [(i, "u", h, None, None) for i, (h, _) in enumerate(made)] + [(7, "u", made[7][0], None, None)] * 300 + [(None, None, long_html, None, None)]
    got = html_blocks.extracted(table(spark, rows)).collect()
    assert len(got) == 361 and {r.text for r in got if r.page_id == 7} == {made[7][1]}
    whole = next(r for r in got if r.page_id is None)
    assert whole.text == f"{long_text}\n\n{('very long text. ' * 20_000).strip()}" and whole.n_chars == len(whole.text)


def test_whole_names_tell_a_role():
    for name in ("comments", "comment-list", "cookie-notice", "site-footer", "ad_1", "disqus_thread", "share-buttons"):
        assert html_blocks.other_name(name), name
    for name in ("side-effects", "share-of-market", "comment-free", "ads-free", "lead", "article-header", "shareholder", "address"):
        assert not html_blocks.other_name(name), name
