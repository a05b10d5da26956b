"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between block tags).  A block is a
vector of hashed tag-path tokens, hashed words and a few measures; a bidirectional LSTM in numpy
reads the whole sequence, so each block is judged with the page around it.  Blocks it labels as
main text are joined in page order.

Training: the ``TRAIN_PAGES`` different pages of smallest hash (a documented bound; pages of over
``TRAIN_CHARS`` characters are left out) give weak labels: a block inside <article> or <main> and in no
container of another role is main text, a block elsewhere is not.  On pages without either tag the
element that holds most unlinked text under its children takes their place.  Copies of these pages lose
their semantic tags, gain lists, sections, tables and harmless class names inside the article and side
blocks with and without telling names outside it, so the network cannot lean on one tag.  Random
numbers are seeded: equal pages give equal weights.  The bound is found on hashes; only the html of the
sample reaches the driver.

Every page is read whole in a map task; there is no shuffle and no row depends on another one.

Defined cases: null, empty and text-free html gives an empty text; unclosed or cut markup is read
as far as it goes; repeated rows are read each; other columns are not read; an empty table gives
no rows (and an untrained labeller).
"""

from __future__ import annotations

import html
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 120
TRAIN_CHARS = 1 << 17
PATH_DIM, WORD_DIM = 64, 16
HIDDEN = 12
COPIES = 4
EPOCHS, RATE, BATCH = 24, 0.02, 24
SEED = 7
GROUP = 128

# fixed values: element kinds
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody "
                   "td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template textarea iframe svg object canvas".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
MAIN_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav aside footer header form menu head title select option dialog fieldset".split())
# fixed values: words of class and id names that tell another role, and words that may stand beside them
ROLE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner comment comments reply replies sidebar side menu nav navbar navigation "
                       "cookie cookies consent gdpr notice popup modal overlay promo promotion share sharing social related recommended teaser teasers footer "
                       "header masthead breadcrumb breadcrumbs newsletter subscribe subscription signup login sponsor sponsored widget widgets disqus "
                       "respond pagination pager toolbar".split())
BESIDE = frozenset("list box block wrapper wrap container section item items body form bar area content site page main top bottom left right inner outer "
                   "slot unit thread text link links button buttons post posts article articles entry story stories primary secondary global local "
                   "mobile desktop row col group panel holder inline small large media author meta title new more us by the is on and".split())
OWN_HEADS = frozenset("article entry post story".split())
NAME_PARTS = re.compile(r"[a-z]+")

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

Block = tuple[str, tuple[str, ...], float, tuple[int, ...]]  # text, path tokens, share of link text, numbers of the elements around
_other_names: dict[str, bool] = {}


def other_name(name: str) -> bool:
    """A class or id name that as a whole tells another role: 'comment-list', but not 'comment-free'."""
    got = _other_names.get(name)
    if got is None:
        if len(_other_names) > 100_000:
            _other_names.clear()
        parts = set(NAME_PARTS.findall(name))
        got = _other_names[name] = bool(parts & ROLE_WORDS) and parts <= ROLE_WORDS | BESIDE and not ("header" in parts and parts & OWN_HEADS)
    return got


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with the tokens of the elements around them."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    number = 0
    parts: list[str] = []
    linked = [0, 0]
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            around = [(tag, names, at) for tag, names, at in stack if tag in BLOCKS or names]
            path = tuple(t for tag, names, _ in around for t in (tag, *names))
            out.append((text, path, min(1.0, linked[0] / max(linked[1], 1)), (0, *[at for _, _, at in around])))
        linked[:] = [0, 0]

    def say(piece: str) -> None:
        parts.append(piece)
        n = len(piece.strip())
        linked[1] += n
        if any(tag == "a" for tag, _, _ in stack):
            linked[0] += n

    def close(names: frozenset | set, upto: frozenset | set = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in upto:
                return

    while True:
        m = TOKEN.search(page, at)
        say(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
        if m[1]:
            # an end tag inside a paragraph does not close what is around its block
            close({tag}, frozenset() if tag in BLOCKS else BLOCKS)
        elif tag in HIDDEN_TAGS and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in SELF_CLOSING:
                close(SELF_CLOSING[tag], {"ul", "ol", "table", "dl", "select", "article", "section", "div", "body"})
            elif tag in BLOCKS:
                close({"p"}, BLOCKS - {"p"})
            names = " ".join(x for g in NAMES.findall(m[3]) for x in g if x).lower().split()
            number += 1
            stack.append((tag, tuple(names), number))
    flush()
    return out


def densest(found: list[Block]) -> int:
    """The element under whose children most unlinked text stands, blocks of other roles aside; 0 is the page."""
    weight: dict[int, float] = {}
    for text, path, link, around in found:
        if not _path(path)[1]:
            n = len(text) * (1 - link)
            for share, at in ((1, around[-2:-1]), (0.5, around[-3:-2])):
                for e in at:
                    weight[e] = weight.get(e, 0) + share * n
    return max(weight, key=lambda e: (weight[e], -e), default=0)


def weak_labels(found: list[Block]) -> np.ndarray | None:
    """1 for blocks of the article: by its tags, or where no block has them by the densest element; None without any."""
    if any(MAIN_TAGS & set(path) for _, path, _, _ in found):
        labels = [bool(MAIN_TAGS & set(path)) and not other_role(path) for _, path, _, _ in found]
    else:
        core = densest(found)
        labels = [core in around and link < 0.5 and not other_role(path) for _, path, link, around in found]
    return np.array(labels, float) if any(labels) else None


def other_role(path: tuple[str, ...]) -> bool:
    inside = max((i for i, t in enumerate(path) if t in MAIN_TAGS), default=-1)
    return any(t in OTHER_TAGS or (t not in BLOCKS and other_name(t)) for t in path[inside + 1:]) or (
        inside < 0 and any(t in OTHER_TAGS for t in path))


EXTRA = 8
DIM = PATH_DIM + WORD_DIM + EXTRA
_paths: dict[tuple[str, ...], tuple[np.ndarray, bool]] = {}
_words: dict[str, int] = {}


def _signed(token: str, dim: int) -> int:
    """Slot of a token; slots from ``dim`` on count down."""
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % dim + (0 if h >> 16 & 1 else dim)


def _path(path: tuple[str, ...]) -> tuple[np.ndarray, bool]:
    """What a block's vector takes from its path, and whether the path tells another role."""
    got = _paths.get(path)
    if got is None:
        if len(_paths) > 20_000:
            _paths.clear()
        row = np.zeros(PATH_DIM + 3)
        for depth, token in enumerate(path):
            for name in (token, f"{token}@{'end' if depth == len(path) - 1 else 'in'}"):
                at = _signed(name, PATH_DIM)
                row[at % PATH_DIM] += 1.0 if at < PATH_DIM else -1.0
        row[PATH_DIM:] = (any(t not in BLOCKS and other_name(t) for t in path), bool(OTHER_TAGS & set(path)), bool(MAIN_TAGS & set(path)))
        got = _paths[path] = (row, other_role(path))
    return got


def _word(word: str) -> int:
    if len(_words) > 200_000:
        _words.clear()
    got = _words[word] = _signed(word, WORD_DIM)
    return got


def vectors(found: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words, measures."""
    x = np.zeros((len(found), DIM))
    core = densest(found)
    for i, (text, path, link, around) in enumerate(found):
        own = _path(path)[0]
        words = text.split(" ")
        slots = np.bincount([_words[w] if w in _words else _word(w) for w in words], minlength=2 * WORD_DIM)
        x[i, :PATH_DIM] = own[:PATH_DIM]
        x[i, PATH_DIM:PATH_DIM + WORD_DIM] = (slots[:WORD_DIM] - slots[WORD_DIM:]) / (np.sqrt(len(words)) * 4)
        x[i, -EXTRA:] = (np.log1p(len(words)) / 4, link, text[-1] in ".!?:;\"", i / len(found), *own[PATH_DIM:], core in around)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in ("f", "b"):
            self.w[f"{d}x"] = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 4 * HIDDEN))
            self.w[f"{d}h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.w[f"{d}c"] = np.zeros(4 * HIDDEN)
            self.w[f"{d}c"][HIDDEN:2 * HIDDEN] = 1.0
        self.w["o"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN)
        self.w["oc"] = np.zeros(1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, HIDDEN) of one direction; padding leaves the state as it is."""
        steps, pages, _ = x.shape
        pre = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, tape = np.zeros((steps, pages, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w[f"{d}h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c1 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c1)
            h1 = m * o * tc + (1 - m) * h
            tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = h1, c1
            out[t] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(d, x, mask)[0] for d in ("f", "b")], axis=2)
        return _sigmoid(states @ self.w["o"] + self.w["oc"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(d, x, mask) for d in ("f", "b")}
        states = np.concatenate([runs[d][0] for d in ("f", "b")], axis=2)
        err = (_sigmoid(states @ self.w["o"] + self.w["oc"]) - y) * mask / max(mask.sum(), 1)
        grad = {"o": np.einsum("tp,tph->h", err, states), "oc": np.array([err.sum()])}
        for at, d in enumerate(("f", "b")):
            own = err[:, :, None] * self.w["o"][at * HIDDEN:(at + 1) * HIDDEN]
            gz = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh = dc = np.zeros((x.shape[1], HIDDEN))
            gh = np.zeros_like(self.w[f"{d}h"])
            for t, h, c, i, f, o, g, tc, m in reversed(runs[d][1]):
                dh = dh + own[t]
                dc = dc + m * dh * o * (1 - tc ** 2)
                z = np.concatenate([m * dc * g * i * (1 - i), m * dc * c * f * (1 - f), m * dh * tc * o * (1 - o),
                                    m * dc * i * (1 - g ** 2)], axis=1)
                gz[t] = z
                gh += h.T @ z
                dh = (1 - m) * dh + z @ self.w[f"{d}h"].T
                dc = dc * (m * f + (1 - m))
            grad[f"{d}h"] = gh
            grad[f"{d}x"] = np.einsum("tpi,tpo->io", x, gz)
            grad[f"{d}c"] = gz.sum(axis=(0, 1))
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adam over padded groups of pages of like length."""
        pages = sorted(pages, key=lambda p: len(p[1]))
        groups = [_padded(pages[i:i + BATCH]) for i in range(0, len(pages), BATCH)]
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for at in rng.permutation(len(groups)):
                step += 1
                for k, g in self.gradients(*groups[at]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((steps, len(pages), DIM)), np.zeros((steps, len(pages))), np.zeros((steps, len(pages)))
    for p, (own, labels) in enumerate(pages):
        x[:len(own), p], mask[:len(own), p], y[:len(own), p] = own, 1.0, labels
    return x, mask, y


# fixed values: what training copies of pages gain: named side blocks, unnamed ones, and blocks of an article
SIDE_PATHS = [("div", "sidebar"), ("aside",), ("div", "comments", "p"), ("section", "comment-list", "div", "comment"), ("div", "cookie-notice"),
              ("form", "p"), ("div", "advert"), ("header", "div"), ("div", "related", "ul", "li"), ("div", "newsletter", "p"), ("div", "ad"),
              ("ul", "menu", "li"), ("footer", "p"), ("div", "share"), ("div", "breadcrumb"), ("div", "promo", "p"), ("nav", "ul", "li"),
              ("div", "disqus_thread", "p"), ("div", "teaser"), ("div", "comments", "ul", "li"), ("aside", "ul", "li"), ("footer", "div", "p")]
PLAIN_SIDES = [("div",), ("div", "p"), ("section", "p"), ("p",), ("ul", "li"), ("div", "ul", "li"), ("div", "div", "p")]
INNER_PATHS = [("p",), ("ul", "li"), ("ol", "li"), ("section",), ("section", "p"), ("dl", "dd"), ("dl", "dt"), ("blockquote",), ("blockquote", "p"),
               ("table", "tbody", "tr", "td"), ("figure", "figcaption"), ("pre",), ("div",), ("div", "p"), ("h2",), ("h3",), ("details",)]
PLAIN_MAIN = ["div", "section", "div"]


def _some_name(rng: np.random.Generator) -> str:
    """A class name that tells nothing; some hold a word that would tell a role were it the whole name."""
    made = "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    return f"{rng.choice(sorted(ROLE_WORDS))}-{made}" if rng.random() < 0.3 else made


def _named(path: tuple[str, ...], share: float, rng: np.random.Generator) -> tuple[str, ...]:
    at = int(rng.integers(len(path))) + 1
    return (*path[:at], _some_name(rng), *path[at:]) if rng.random() < share else path


def _shared(rows: list[tuple]) -> tuple:
    low, high = min(rows), max(rows)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    return low[:n]


def varied(found: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A copy of a page: other tags around its article, other blocks and names in it, side blocks before, in and after it."""
    swap = {t: (str(rng.choice(PLAIN_MAIN)),) if rng.random() < 0.5 else (t,) for t in MAIN_TAGS}
    own = f"c-{_some_name(rng)}" if rng.random() < 0.5 else ""
    copy = []
    for text, path, link, around in found:
        path = tuple(s for t in path for s in ((*swap[t], own) if t in MAIN_TAGS and own else swap.get(t, (t,))))
        copy.append((text, path, link, around))
    main = [i for i, y in enumerate(labels) if y]
    # a lone block gives its parent
    home = _shared([copy[i][1][:-1] for i in main])
    inside = _shared([copy[i][3][:-1] for i in main])
    fresh = itertools.count(1 << 20)
    words = " ".join(b[0] for b in copy).split(" ")

    def block(before: tuple, path: tuple, around: tuple, link: float) -> Block:
        a = int(rng.integers(len(words)))
        text = " ".join(words[a:a + int(rng.integers(1, 40))])
        return text + ("." if rng.random() < 0.5 else ""), (*before, *path), link, (*around, *[next(fresh) for _ in path])

    def inner() -> tuple[str, ...]:
        return _named(INNER_PATHS[int(rng.integers(len(INNER_PATHS)))], 0.3, rng)
    rate = rng.random() * 0.5
    rows = []
    for i, (b, y) in enumerate(zip(copy, labels, strict=True)):
        if y and rng.random() < rate:
            path = inner()
            b = (b[0], (*home, *path), b[2], (*inside, *[next(fresh) for _ in path]))
        rows.append((float(i), b, y))
    for _ in range(int(rng.integers(0, 5))):
        at = main[-1] + 0.5 if rng.random() < 0.4 else rng.uniform(main[0], main[-1] + 0.5)
        path = inner()
        alike = int(rng.integers(1, 4)) if path[-1] in ("li", "dd", "td", "dt") else 1
        rows += [(at, block(home, path, inside, float(rng.random() < 0.05)), 1.0) for _ in range(alike)]
    top, root = ("html", "body"), inside[:3]
    for _ in range(int(rng.integers(0, 5))):
        after = rng.random() < 0.6
        at = main[-1] + 0.75 if after else rng.uniform(-1, main[0])
        if rng.random() < 0.6 or len(inside) <= 3:
            side = SIDE_PATHS[int(rng.integers(len(SIDE_PATHS)))]
            if rng.random() < 0.3:
                rows.append((rng.uniform(main[0], main[-1] + 0.5), block(home, side, inside, float(rng.random() < 0.2)), 0.0))
                continue
        else:
            side = _named(PLAIN_SIDES[int(rng.integers(len(PLAIN_SIDES)))], 0.3, rng)
        rows.append((at, block(top, side, root, float(rng.random() < 0.2)), 0.0))
    rows.sort(key=lambda r: r[0])
    return [b for _, b, _ in rows], np.array([y for _, _, y in rows])


def trained(pages: DataFrame) -> Labeller:
    """A labeller fitted on a bounded sample of the given pages."""
    model, rng = Labeller(), np.random.default_rng(SEED)
    hashed = pages.where(F.length("html") <= TRAIN_CHARS).select("html", F.xxhash64("page_id", "html").alias("h"))
    # copies of a page are one; the html is read for the sample alone
    least = hashed.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).agg(F.max("h")).first()[0]
    sample = [] if least is None else hashed.where(F.col("h") <= least).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    made = []
    for row in sample:
        found = blocks(row["html"])
        labels = weak_labels(found) if found else None
        if labels is None:
            continue
        made.append((vectors(found), labels))
        for _ in range(COPIES):
            other, y = varied(found, labels, rng)
            made.append((vectors(other), y))
    if made:
        model.train(made)
    return model


def labelled(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Per page its blocks' scores, computed for pages of like length together."""
    out = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    for a in range(0, len(order), GROUP):
        part = order[a:a + GROUP]
        x, mask, _ = _padded([(vectors(pages[i]), np.zeros(len(pages[i]))) for i in part])
        s = model.scores(x, mask)
        for p, i in enumerate(part):
            out[i] = s[:len(pages[i]), p]
    return out


def main_text(found: list[Block], scores: np.ndarray) -> str:
    return "\n\n".join(text for (text, _, _, _), s in zip(found, scores, strict=True) if s >= 0.5)


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    own = model or trained(pages)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for a in range(0, batch.num_rows, GROUP):
                found = [blocks(x.as_py()) for x in batch.column(2).slice(a, GROUP)]
                texts.extend(main_text(f, s) for f, s in zip(found, labelled(own, found), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        batches, f"page_id {kind}, url string, text string, n_chars bigint")
