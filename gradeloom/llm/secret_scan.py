"""Secret scan with a recursive decoding worklist.

A text is layer zero.  From each layer the worklist takes the layers it hides: percent escapes
and Unicode, backslash, numeric or named character escapes decoded in place, and the readable
stretches of what base64 runs hold, directly or after gzip, zlib, raw deflate, bzip2 or xz
decompression.  Escapes that are bytes rather than text are also decoded to one character a byte,
and compressed streams in such characters are unpacked like those in base64.  A base64 run is read line by line
and joined over single line breaks, from each of its four alignments, so a name before it
('config/...') does not put it out of step.  Each new layer is scanned with the same patterns and
put on the worklist, until nothing new appears.  A layer that was seen before at the same place is
not taken again, so cycles end.

Every layer carries, per character, the piece of the original text it stands for, so a secret
found deep inside maps to a span of the document.  Texts are handled one by one in map tasks: no
shuffle.  Compressed layers have no size limit: all their members are unpacked ``CHUNK`` bytes at a
time and handed on in pieces cut where no secret, run or escape can stand, so memory is that of
one text and its layers, and of the longest unbroken run of an unpacked one.  A stream that breaks off
gives what was readable before, its span going on to the end of its run; a zlib stream, whose two
bytes of header turn up by chance, does so only at the start of a base64 run or among byte escapes.  Raw deflate has no
header: it counts where it reaches its end and all it holds is readable.

A stretch is at least ``MIN_RUN`` ASCII characters, in one byte or in UTF-16: secrets are ASCII and
no shorter, and neither is anything that can be decoded further.

Defined cases: null and empty texts have no spans; repeated rows are scanned each; a span found
in several layers is given once; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bz2
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex"]
CHUNK = 1 << 20
MIN_RUN = 16

# fixed values: the patterns of the three kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\[uU]([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
                    r"|&([A-Za-z][A-Za-z0-9]{1,31};)|\\([abfnrtv0\\'\"/])")
# fixed values: what the one-letter escapes stand for
LETTERS = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
LETTER = "[A-Za-z0-9+/_-]"
BASE64 = re.compile(LETTER + "{%d,}={0,2}" % MIN_RUN)
WRAPPED = re.compile(rf"(?<!{LETTER}){LETTER}++(?:\r?\n[ \t]*+{LETTER}++)++={{0,2}}")
BLANKS = re.compile(r"[ \t\r\n]+")
CUTS = re.compile("[/_-]")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % MIN_RUN)
WIDE = re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){%d,}|(?:[\t\n\r\x20-\x7e]\x00){%d,}" % (MIN_RUN, MIN_RUN))
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)
# runs of characters that can be bytes, and the ones that prose of any language lacks
BYTES = re.compile(r"[\x00-\xff]+")
ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")
# where raw deflate may begin and what may follow it
OPENS = re.compile(rb"(?:^|(?<=[\t\n\r \"'=:,(<>]))(?=[\x00-\xff]{0,32}?[\x00-\x08\x0e-\x1f\x7f-\x9f])")
CLOSES = b"\t\n\r \"'&,;)<>"
# bytes that no secret, run or escape holds, in one byte or in UTF-16, as 1
APART = bytes(0 if chr(b) in "\0\t\n\r \"'%&#;\\{}+/_.=:-" or chr(b).isascii() and chr(b).isalnum() else 1 for b in range(256))

Span = tuple[int, int, int]  # kind, start, end


def find(text: str) -> list[Span]:
    """Spans of the three kinds in one layer, leftmost and not overlapping within a kind."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """Text with the original start and end of each character."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def root(cls, text: str) -> Layer:
        at = np.arange(len(text))
        return cls(text, at, at + 1)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def key(self) -> tuple:
        return (self.span(0, len(self.text)) if self.text else (0, 0)), sha256(self.text.encode("utf-8", "surrogatepass")).digest()


def _replaced(layer: Layer, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer | None:
    """The layer with [start, end) replaced by characters that stand for given pieces of it."""
    if not edits:
        return None
    text, starts, ends, at = [], [], [], 0
    for start, end, chars in edits:
        text.append(layer.text[at:start])
        starts.append(layer.starts[at:start])
        ends.append(layer.ends[at:start])
        text.extend(c for c, _, _ in chars)
        starts.append(np.array([layer.starts[a] for _, a, _ in chars], np.int64))
        ends.append(np.array([layer.ends[b - 1] for _, _, b in chars], np.int64))
        at = end
    text.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def percent_layer(layer: Layer) -> Layer | None:
    """Percent escapes decoded in place; bytes that are no UTF-8 stay as they are."""
    edits = []
    for m in PERCENT.finditer(layer.text):
        chars, first, at = [], m.start(), m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            kept = 0xDC80 <= ord(c) <= 0xDCFF
            width = 3 if kept else 3 * len(c.encode("utf-8"))
            if not kept:
                chars.append((c, at, at + width))
            elif chars:
                edits.append((first, at, chars))
                chars = []
            at += width
            if kept:
                first = at
        if chars:
            edits.append((first, at, chars))
    return _replaced(layer, edits)


def percent_bytes(layer: Layer) -> Iterator[Layer]:
    """Percent escapes decoded to one character a byte where some are no text; '+' as itself and as a blank."""
    runs = [(m.start(), bytes.fromhex(m[0].replace("%", ""))) for m in PERCENT.finditer(layer.text)]
    if not any(_binary(data) for _, data in runs):
        return
    edits = [(at + 3 * i, at + 3 * i + 3, [(chr(b), at + 3 * i, at + 3 * i + 3)]) for at, data in runs for i, b in enumerate(data)]
    yield _replaced(layer, edits)
    blanks = [(m.start(), m.end(), [(" ", m.start(), m.end())]) for m in re.finditer(r"\+", layer.text)]
    if blanks:
        yield _replaced(layer, sorted(edits + blanks))


def _binary(data: bytes) -> bool:
    try:
        return CONTROL.search(data.decode("utf-8")) is not None
    except UnicodeDecodeError:
        return True


def escape_layer(layer: Layer) -> Layer | None:
    """Unicode, backslash, numeric and named character escapes decoded in place; surrogate pairs are one character."""
    edits: list = []
    for m in ESCAPE.finditer(layer.text):
        place = m.start(), m.end()
        if m[6] or m[7]:
            chars = html5.get(m[6], "") if m[6] else LETTERS.get(m[7], m[7])
            if chars:
                edits.append((*place, [(c, *place) for c in chars]))
            continue
        digits = next(g for g in m.groups() if g)
        code = int(digits, 10 if m[5] else 16)
        if code > 0x10FFFF:
            continue
        last = edits[-1] if edits else None
        if 0xDC00 <= code < 0xE000 and last and last[1] == m.start() and 0xD800 <= ord(last[2][0][0]) < 0xDC00:
            joined = chr(0x10000 + ((ord(last[2][0][0]) - 0xD800) << 10) + code - 0xDC00)
            edits[-1] = (last[0], m.end(), [(joined, last[0], m.end())])
        else:
            edits.append((*place, [(chr(code), *place)]))
    return _replaced(layer, [e for e in edits if not 0xD800 <= ord(e[2][0][0]) < 0xE000])


def _member(data: bytes, at: int, step: int = CHUNK, raw: bool = False) -> Iterator[tuple[bytes, int]]:
    """Chunks of the compressed stream at ``at``, each with the place where it ends: 0 until then, -1 where it breaks off."""
    if raw:
        tool = zlib.decompressobj(-zlib.MAX_WBITS)
    elif data[at] == 0x42:
        tool = bz2.BZ2Decompressor()
    elif data[at] == 0xFD:
        tool = lzma.LZMADecompressor()
    else:
        tool = zlib.decompressobj(zlib.MAX_WBITS | 32)
    view, feed = memoryview(data), b""
    while True:
        if not len(feed) and getattr(tool, "needs_input", True):
            feed = view[at:at + step]
            at += len(feed)
        try:
            out = tool.decompress(feed, CHUNK)
        except BROKEN:
            yield b"", -1
            return
        if tool.eof:
            yield out, at - len(tool.unused_data)
            return
        feed = getattr(tool, "unconsumed_tail", b"")
        if not out and not feed and at >= len(data):
            yield b"", -1
            return
        yield out, 0


def _members(data: bytes, at: int, chance: bool) -> tuple[list[tuple[int, int]], int, int]:
    """(start, step) of the streams that follow one another from ``at``, where the last one ends, and where to look on.

    ``chance``: the header at ``at`` may be no header, so a stream that breaks off there is none.
    """
    starts, end, on = [], at, at + 1
    while PACKED.match(data, at):
        for _, stop in _member(data, at):
            pass
        if stop < 0:
            if starts or not chance:
                starts.append((at, 64))  # short steps, so that a fault takes little of what stands before it
                end = len(data)
            break
        starts.append((at, CHUNK))
        at = end = on = stop
        while data[at:at + 1] == b"\0":  # padding between members
            at += 1
    return starts, end, on


def _cut(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The stream in pieces of about ``CHUNK`` bytes, cut only where nothing that counts can stand."""
    held = bytearray()
    for chunk in chunks:
        before = max(len(held) - 1, 0)
        held += chunk
        if len(held) >= CHUNK:
            new = bytes(held[before:])
            at = max(new.translate(APART).rfind(1), new.rfind(b"\0\0"), new.rfind(b"\n\n")) + 1
            if at:
                yield bytes(held[:before + at])
                del held[:before + at]
    if held:
        yield bytes(held)


def _stretches(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Readable text of ``data`` with the first byte of each character and the byte after it: all of it, or stretches."""
    if len(data) < MIN_RUN:
        return
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = "\0"
    if not CONTROL.search(text):
        widths = np.array([len(c.encode("utf-8")) for c in text]) if len(text) < len(data) else np.ones(len(text), np.int64)
        stop = np.cumsum(widths)
        yield text, stop - widths, stop
        return
    for m in PLAIN.finditer(data):
        first = np.arange(m.start(), m.end())
        yield m[0].decode("ascii"), first, first + 1
    for m in WIDE.finditer(data):
        text = m[0].replace(b"\0", b"").decode("ascii")
        first = m.start() + 2 * np.arange(len(text))
        yield text, first, first + 2


def _unpacked(data: bytes, first, past, sure) -> Iterator[Layer]:
    """Layers of the compressed streams in ``data``; ``first`` and ``past`` give the original start and end of bytes."""
    m = PACKED.search(data)
    while m:
        at = m.start()
        starts, stop, on = _members(data, at, data[at] == 0x78 and not sure(at))
        if starts:
            a, b = first(at), past(stop)
            chunks = (chunk for s, step in starts for chunk, _ in _member(data, s, step))
            yield from _pieces(chunks, a, b)
        m = PACKED.search(data, on)


def _pieces(chunks: Iterator[bytes], a: int, b: int) -> Iterator[Layer]:
    """Layers of an unpacked stream that stands for the original [a, b)."""
    chunks = iter(chunks)
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) >= 16:
            break
    if PACKED.match(head):
        # a stream in a stream: one character a byte, so that the worklist unpacks it and knows it again
        text = (head + b"".join(chunks)).decode("latin-1")
        yield Layer(text, np.broadcast_to(a, len(text)), np.broadcast_to(b, len(text)))
        return
    for piece in _cut(itertools.chain([head], chunks)):
        for t, _, _ in _stretches(piece):
            yield Layer(t, np.broadcast_to(a, len(t)), np.broadcast_to(b, len(t)))


def _raw_deflated(data: bytes, at: int, first, past, to_end: bool) -> Iterator[Layer]:
    """The layer of a raw deflate stream at ``at`` that reaches its end, if all it holds is readable."""
    size, stop, early = 0, 0, b""
    for out, stop in _member(data, at, raw=True):
        early = early or out
        size += len(out)
        if early and CONTROL.search(early[:4096].decode("latin-1")):
            return
    if stop < 0 or size < MIN_RUN or (stop < len(data) and (to_end or data[stop] not in CLOSES)):
        return
    readable = True
    for piece in _cut(chunk for chunk, _ in _member(data, at, raw=True)):
        readable = readable and not _binary(piece)
    if readable:
        yield from _pieces((chunk for chunk, _ in _member(data, at, raw=True)), first(at), past(stop))


def byte_layers(layer: Layer) -> Iterator[Layer]:
    """Layers of the compressed streams and of the two-byte text that a layer holds as one character a byte."""
    for m in BYTES.finditer(layer.text) if ODD.search(layer.text) else ():
        if not ODD.search(m[0]):
            continue
        data = m[0].encode("latin-1")
        first = lambda i: layer.starts[m.start() + i]  # noqa: B023, E731
        past = lambda i: layer.ends[m.start() + i - 1]  # noqa: B023, E731
        for w in WIDE.finditer(data):
            at = m.start() + w.start() + 2 * np.arange(len(w[0]) // 2)
            yield Layer(w[0].replace(b"\0", b"").decode("ascii"), layer.starts[at], layer.ends[at + 1])
        yield from _unpacked(data, first, past, lambda i: data[i + 1] != 0x5E)  # noqa: B023
        for o in OPENS.finditer(data):
            yield from _raw_deflated(data, o.start(), first, past, False)


def _run_layers(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """Layers of the run in [start, end), blanks aside, from each alignment."""
    text = layer.text[start:end]
    place = np.arange(start, end)
    if BLANKS.search(text):
        blank = np.zeros(end - start, bool)
        for m in BLANKS.finditer(text):
            blank[m.start():m.end()] = True
        text, place = BLANKS.sub("", text), place[~blank]
    run = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) < MIN_RUN:
        return
    # a name may end at one of these letters and the encoded text begin behind it
    cuts = [m.end() for m in CUTS.finditer(text)]
    for skip in range(4):
        own = run[skip:]
        own = own[:len(own) - (len(own) % 4 == 1)]
        data = base64.b64decode(own + "=" * (-len(own) % 4))
        at = place[skip:]
        lay = lambda i: at[4 * (i // 3)]  # noqa: B023, E731
        past = lambda i: at[np.minimum(4 * -(-i // 3), len(at)) - 1]  # noqa: B023, E731
        begins = np.array([3 * ((c - skip) // 4) for c in cuts if c % 4 == skip], np.int64)
        whole = False
        for t, first, stop in _stretches(data):
            whole = whole or int(stop[-1] - first[0]) == len(data)
            starts, ends = layer.starts[lay(first)], layer.ends[past(stop)]
            yield Layer(t, starts, ends)
            within = begins[np.searchsorted(begins, first[0], "right"):np.searchsorted(begins, stop[-1])]
            edges = [*np.unique(np.searchsorted(first, within)), len(t)]
            for a, b in itertools.pairwise(edges):
                if b - a >= MIN_RUN:
                    yield Layer(t[a:b], starts[a:b], ends[a:b])
        if not whole:
            first_of = lambda i: layer.starts[lay(i)]  # noqa: B023, E731
            past_of = lambda i: layer.ends[past(i)]  # noqa: B023, E731
            yield from _unpacked(data, first_of, past_of, lambda i: i == 0)
            yield from _raw_deflated(data, 0, first_of, past_of, True)


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """The layers that base64 runs hide, of single lines and joined over line breaks."""
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(layer.text):
            yield from _run_layers(layer, m.start(), m.end())


def _hidden(layer: Layer) -> Iterator[Layer]:
    for decoded in (percent_layer, escape_layer):
        inner = decoded(layer)
        if inner is not None:
            yield inner
    yield from percent_bytes(layer)
    yield from byte_layers(layer)
    yield from base64_layers(layer)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by start, kind and end."""
    base = find(text)
    found, seen = set(base), set()
    hides = "%" in text or "\\" in text or "&" in text or BASE64.search(text) is not None or WRAPPED.search(text) is not None
    work = [iter([Layer.root(text)])] if hides else []
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        if len(seen) > 1:
            found.update((kind, *layer.span(a, b)) for kind, a, b in find(layer.text))
        work.append(_hidden(layer))
    order = lambda s: (s[1], s[0], s[2])
    return sorted(base, key=order), sorted(found, key=order)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base spans by kind, and base and all spans as text."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, base, every = ([], [], []), [], []
            for text in batch.column(1):
                own, found = scan(text.as_py() or "")
                for kind, col in enumerate(counts):
                    col.append(sum(s[0] == kind for s in own))
                base.append(digest(own))
                every.append(digest(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        batches, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")
