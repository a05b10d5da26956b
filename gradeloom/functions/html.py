"""Page markup to text blocks; everything after that is Column work."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradeloom.functions import rules as R
from gradeloom.functions import text as X

SLICE_PAGES = 128

# ---- fixed values: markup roles, widget classes and page wording --------------------------
BLOCK_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "div", "article", "section", "title",
              "footer", "nav"}
CLOSED_BY_NEXT = {"p": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "div", "article", "section",
                        "footer", "nav", "ul", "table"}, "li": {"li"}, "td": {"td", "tr"}}
VOID_TAGS = {"br", "img", "hr", "meta", "link", "input"}
SILENT_TAGS = {"script", "style"}
TITLE_CLASSES = r"\bfield--name-field-essaytitle\b|\bfield-field-essaytitle\b"
WIDGET_CLASSES = (
    r"\b(field--name-field-essaytitle|field-field-essaytitle|field--name-field-vote|field-field-vote|"
    r"fivestar-widget|links|node__links|comment|comment-wrapper|view|block|field--name-taxonomy-vocabulary-1|"
    r"field-type-taxonomy-term-reference|average-rating|fivestar-summary)(?=\s|$)"
)
WIDGETS = [
    "field--name-field-essaytitle", "field-field-essaytitle", "field--name-field-vote", "field-field-vote", "fivestar-widget", "links",
    "node__links", "comment", "comment-wrapper", "view", "block", "field--name-taxonomy-vocabulary-1", "field-type-taxonomy-term-reference",
    "average-rating", "fivestar-summary",
]
ESSAY_NODES = [("article", "node--essay"), ("div", "node"), (None, "l-content")]
CONTENT_NODES = [(None, "node__content"), ("div", "content")]
ARTICLE_NODES = [("article", None), (None, "entry-content"), ("main", None)]
ASIDE_TAGS = ["aside", "nav", "form"]
STOP_MARKERS = (
    r"(?i)^(Average|Select rating|Cancel rating|Give it|Login|or\s*$|register|Facebook|Google Plus|Send by email|"
    r"Source & Links|Tags|Essay Categories|Votes:|Comments|More essays by this user)"
)
SUBMITTED = r"(?i)Submitted by\s+(.+?)\s+on\s+(.+?)\s*(?:-\s*\d{1,2}:\d{2})?$"
POSTED = r"(?i)By\s+(\S+)\s*-\s*Posted on\s+(.+?)$"
BOT_AUTHOR = r"(?i)e-?\s?(grader|rater)"
MACHINE_SCORE = r"(?i)(?:Scores?\s+by\s+essay\s+e-?grader|Final\s+score)\s*:?\s*([0-9](?:\.[05])?)\s*out\s+of\s+6"
RATES = r"(?i)Rates?\s*:\s*([\d.]+)\s*out of 100"
STARS = r"Average:\s*([\d.]+)"
SECTION_SCORE = r"Score:?\s*([0-6](?:\.\d)?)\b"
# -------------------------------------------------------------------------------------------

BLOCKS = ArrayType(StructType([StructField(n, StringType()) for n in ("tag", "cls", "text")]))
# places count the opening and closing of elements and blocks, so "inside" is a test on numbers
TREE = StructType([
    StructField("blocks", ArrayType(StructType([*BLOCKS.elementType.fields, StructField("at", IntegerType())]))),
    StructField("nodes", ArrayType(StructType([
        StructField("tag", StringType()), StructField("cls", StringType()), StructField("open", IntegerType()), StructField("close", IntegerType())]))),
])
# elements that nothing selects are not listed, only counted
NODE_TAGS = {"article", "main", "aside", "nav", "form"}


class _Blocks(HTMLParser):
    """Collects (tag, classes of the element and its ancestors, text) per block, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, str, list[str]]] = []
        self.silent = 0
        self.place = 0
        self.at: list[int] = []
        self.nodes: list[list] = []
        self.open: list[list] = []  # one per entry of the stack

    def _next(self) -> int:
        self.place += 1
        return self.place

    def _pop(self) -> str:
        self.open.pop()[3] = self._next()
        return self.stack.pop()[0]

    def finish(self) -> None:
        """Elements that the page leaves open end with it."""
        while self.stack:
            self._pop()

    def _open_block(self):
        tag = next((t for t, _ in reversed(self.stack) if t in BLOCK_TAGS), "")
        form = " form" if any(t == "form" for t, _ in self.stack) else ""
        self.blocks.append((tag, " ".join(c for _, c in self.stack if c) + form, []))
        self.at.append(self._next())

    def handle_starttag(self, tag, attrs):
        if tag in SILENT_TAGS:
            self.silent += 1
            return
        if tag in VOID_TAGS:
            return
        while self.stack and tag in CLOSED_BY_NEXT.get(self.stack[-1][0], ()):
            self._pop()
        cls = dict(attrs).get("class") or ""
        self.stack.append((tag, cls))
        self.open.append([tag, cls, self._next(), 0])
        if cls or tag in NODE_TAGS:
            self.nodes.append(self.open[-1])
        if tag in BLOCK_TAGS:
            self._open_block()

    def handle_endtag(self, tag):
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
            return
        if any(t == tag for t, _ in self.stack):
            while self._pop() != tag:
                pass
            if tag in BLOCK_TAGS:
                self._open_block()

    def handle_data(self, data):
        if self.silent or not data.strip():
            return
        if not self.blocks:
            self._open_block()
        self.blocks[-1][2].append(data.strip())


def _parsed(html: str) -> _Blocks:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    return parser


def _sliced(pages: Iterator[pd.Series], convert) -> Iterator:
    """``convert`` of a few pages at a time: the trees of a page take many times its bytes."""
    for batch in pages:
        # an empty batch gives an empty answer
        for i in range(0, max(1, len(batch)), SLICE_PAGES):
            yield convert(batch.iloc[i:i + SLICE_PAGES])


@F.pandas_udf(BLOCKS)
def html_blocks(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(html):
        if html is None:
            return None
        return [{"tag": t, "cls": c, "text": unicodedata.normalize("NFKC", " ".join(s))} for t, c, s in _parsed(html).blocks if s]

    return _sliced(pages, lambda some: some.map(one))


@F.pandas_udf(TREE)
def html_tree(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Text blocks with their places, and the elements with a class or a sectioning tag as place ranges."""
    def one(html):
        if html is None:
            return None, None
        parser = _parsed(html)
        parser.finish()
        blocks = [{"tag": t, "cls": c, "text": unicodedata.normalize("NFKC", " ".join(s)), "at": at}
                  for (t, c, s), at in zip(parser.blocks, parser.at, strict=True) if s]
        return blocks, [dict(zip(("tag", "cls", "open", "close"), n, strict=True)) for n in parser.nodes]

    def some(html):
        rows = [one(h) for h in html]
        return pd.DataFrame({"blocks": [b for b, _ in rows], "nodes": [n for _, n in rows]})

    return _sliced(pages, some)


def has_class(node: Column, name: str) -> Column:
    return F.array_contains(F.split(node["cls"], r"\s+"), name)


def is_node(node: Column, tag: str | None, cls: str | None) -> Column:
    return (F.lit(True) if tag is None else node["tag"] == tag) & (F.lit(True) if cls is None else has_class(node, cls))


def first_node(nodes: Column, wanted: list[tuple[str | None, str | None]], under: Column | None = None) -> Column:
    """The first element, in page order, of the first kind in ``wanted`` that there is; only inside ``under`` if given."""
    def found(tag, cls):
        return F.get(F.filter(nodes, lambda n: is_node(n, tag, cls) & (F.lit(True) if under is None else inside(n["open"], under))), F.lit(0))
    return F.coalesce(*[found(tag, cls) for tag, cls in wanted])


def inside(place: Column, node: Column) -> Column:
    """Whether a place lies in an element; a missing element is the whole page."""
    return node.isNull() | ((place > node["open"]) & (place < node["close"]))


def blocks_in(tree: Column, node: Column, without) -> Column:
    """Blocks inside ``node``, and not inside one of its elements for which ``without`` holds."""
    gone = F.filter(tree["nodes"], lambda n: inside(n["open"], node) & without(n))
    return F.filter(tree["blocks"], lambda b: inside(b["at"], node) & ~F.exists(gone, lambda n: inside(b["at"], n)))


def essay_blocks(tree: Column) -> Column:
    """Blocks of the essay node's content, without its widgets: what lies around the node is no part of it."""
    nodes = tree["nodes"]
    node = first_node(nodes, ESSAY_NODES)
    content = F.coalesce(first_node(nodes, CONTENT_NODES, node), node)
    widget = lambda n: F.arrays_overlap(F.split(n["cls"], r"\s+"), F.array(*[F.lit(w) for w in WIDGETS])) | (n["tag"] == "form")
    return F.filter(blocks_in(tree, content, widget), lambda b: b["tag"] != "title")


def article_blocks(tree: Column) -> Column:
    """Blocks of the article, without asides, menus and forms."""
    return blocks_in(tree, first_node(tree["nodes"], ARTICLE_NODES), lambda n: n["tag"].isin(*ASIDE_TAGS))


def _texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: X.clean_text(b.text, unicode=False))


def page_prompt(blocks: Column) -> Column:
    """Title field, then the block after an 'Essay topic' label, then a hidden title, then a long h1."""
    field = F.array_join(_texts(F.filter(blocks, lambda b: b.cls.rlike(TITLE_CLASSES))), " ")
    label_at = F.array_position(F.transform(blocks, lambda b: b.text.rlike(r"(?i)^\s*Essay topic\s*:?\s*$")), F.lit(True))
    after = F.when(label_at > 0, X.clean_text(F.get(blocks, label_at.cast("int"))["text"], unicode=False))
    hidden = F.array_join(_texts(F.filter(blocks, lambda b: b.cls.rlike(r"\bhidetitle\b"))), " ")
    heads = F.filter(_texts(F.filter(blocks, lambda b: b.tag == "h1")),
                     lambda h: (F.length(h) > 40) & ~F.contains(h, F.lit("TOEFL IELTS")))
    long_enough = lambda c: F.when(F.length(c) > 40, c)
    return F.coalesce(long_enough(field), long_enough(after), long_enough(hidden), F.get(heads, F.lit(0)), F.lit(""))


def page_body(blocks: Column, min_words: int = 80) -> Column:
    """Paragraph blocks outside widgets; whole text up to the first stop marker when they are too few."""
    content = F.filter(blocks, lambda b: ~b.cls.rlike(WIDGET_CLASSES) & ~b.cls.rlike(r" form$") & (b.tag != "title"))
    return _body(content, min_words)


def essay_body(tree: Column, min_words: int = 80) -> Column:
    """As ``page_body``, of the essay node alone."""
    return _body(essay_blocks(tree), min_words)


def _body(content: Column, min_words: int) -> Column:
    paras = F.filter(_texts(F.filter(content, lambda b: b.tag == "p")), lambda p: (p != "") & ~p.rlike(STOP_MARKERS))
    words = F.aggregate(paras, F.lit(0), lambda a, p: a + X.word_count(p))
    lines = _texts(content)
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(STOP_MARKERS)), F.lit(True)).cast("int")
    upto = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(lines)
    return F.when(words >= min_words, F.array_join(paras, "\n\n")).otherwise(
        X.clean_text(F.array_join(upto, "\n"), unicode=False))


def page_meta(blocks: Column) -> Column:
    """Struct(author, date) from a submission line; machine accounts are not authors."""
    lines = _texts(F.filter(blocks, lambda b: b.text.rlike(SUBMITTED) | b.text.rlike(POSTED)))

    def who(s):
        return F.when(s.rlike(SUBMITTED), F.regexp_extract(s, SUBMITTED, 1)).otherwise(F.regexp_extract(s, POSTED, 1))

    human = F.get(F.filter(lines, lambda s: ~who(s).rlike(BOT_AUTHOR)), F.lit(0))
    when = F.when(human.rlike(SUBMITTED), F.regexp_extract(human, SUBMITTED, 2)).otherwise(F.regexp_extract(human, POSTED, 2))
    return F.struct(
        F.coalesce(X.strip_ws(who(human)), F.lit("")).alias("author"), R.iso_date_from_text(when).alias("date"))


def page_scores(full_text: Column) -> Column:
    def pick(rx):
        return F.nullif(F.regexp_extract(full_text, rx, 1), F.lit(""))
    return F.struct(
        pick(MACHINE_SCORE).try_cast("double").alias("machine_score"), pick(RATES).alias("rates"), pick(STARS).alias("stars"))


def section_score(analysis: Column) -> Column:
    return F.nullif(F.regexp_extract(analysis, SECTION_SCORE, 1), F.lit("")).try_cast("double")


def canonical_url(url: Column) -> Column:
    """https://host/category/slug for two-segment detail pages; NULL with a query or fragment."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = ~F.contains(url, F.lit("?")) & ~F.contains(url, F.lit("#"))
    return F.when(plain & (host != "") & (F.size(segs) == 2), F.concat(F.lit("https://"), host, F.lit("/"), F.array_join(segs, "/")))


def snapshot_parts(url: Column) -> Column:
    """Struct(ts, original) of an archived page address."""
    rx = r"^https?://[^/]+/web/(\d+)id_/(.+)$"
    return F.when(url.rlike(rx), F.struct(
        F.regexp_extract(url, rx, 1).alias("ts"), F.regexp_extract(url, rx, 2).alias("original")))
