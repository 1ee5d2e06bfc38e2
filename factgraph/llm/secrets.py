"""Secret scans: recursive decoding of nested layers by a worklist until a fixpoint.

A layer is a decoded text with a table of pieces that says where its code points stand in the original text. The layers
below it are: its lines with all URL and Unicode escapes undone at once; each base64 run, at its four alignments; what
compressed streams hold, wherever one begins in decoded bytes. The worklist is a stack, so depth costs no recursion; a
layer equal to one seen for the same stretch of the original closes a cycle, or was reached by another order, and is
dropped. Bytes are scanned as Latin-1, since all patterns are ASCII, and once more without NULs (UTF-16 and UTF-32).
Large streams are scanned by overlapping windows, so that no size is too large.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, map_rows

KINDS = ("assign", "access", "hex")
_DETECT = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: m.end(2) - m.start(2) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: m.end() - m.start() >= 24),
)
#: Runs of hexadecimal digits that can pass; a longer-run prefilter with the same matches as the rule above.
_HEX_LONG = re.compile("[0-9a-f]{24,}")
#: Words of which one is in any text that the first rule can match.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Escapes; ``sign`` is one that spells the sign of an escape, in any spelling.
_CODES, _NUMBERS = "(?:2[56]|5[Cc])", "(?:3[78]|92)"
_AFTER = {
    "%": f"(?:{_CODES}|u00{_CODES})",
    r"\\": rf"(?:x{_CODES}|u00{_CODES}|U000000{_CODES}|u\{{0{{0,4}}{_CODES}\}})",
    "&": f"(?:amp|#0{{0,5}}{_NUMBERS}|#[Xx]0{{0,4}}{_CODES});",
}
_ESCAPE = re.compile(
    "(?P<sign>" + "|".join(s + a for s, a in _AFTER.items()) + ")"
    r"|(?P<percent>(?:%[0-9A-Fa-f]{2})+)|(?P<units>(?:[\\%]u[0-9A-Fa-f]{4})+)"
    r"|\\U(?P<long>[0-9A-Fa-f]{8})|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|\\x(?P<byte>[0-9A-Fa-f]{2})|&#(?P<decimal>[0-9]{1,7});|&#[Xx](?P<hex>[0-9A-Fa-f]{1,6});|&(?P<name>quot|apos|lt|gt);"
)
#: What after a sign makes an escape that again spells a sign.
_MORE_SIGNS = {s[-1]: re.compile(a) for s, a in _AFTER.items()}
#: One escape at the end of a text.
_ENDING = re.compile(r"(?:%(?P<percent>[0-9A-Fa-f]{2})|[\\%]u(?P<unit>[0-9A-Fa-f]{4})|\\U(?P<long>[0-9A-Fa-f]{8})|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|\\x(?P<byte>[0-9A-Fa-f]{2})|&#(?P<decimal>[0-9]{1,7});|&#[Xx](?P<hex>[0-9A-Fa-f]{1,6});|&(?P<name>quot|apos|lt|gt|amp);)\Z")
#: Levels of escapes that are undone one by one. Deeper ones, which only grow with the text if it is made to, are undone at once.
LEVELS = 32
_NAMED = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&"}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+")
#: A line that goes on with a base64 run: as long as the first, or shorter and the last. Nothing but padding, white space or
#: the end of a quotation follows.
_MORE = re.compile(r"""\r?\n[ \t]*([A-Za-z0-9+/_-]++)(?==*[ \t]*(?:[\r\n"'<,;)]|\Z))""")
#: Stretches that may spell bytes by percent escapes, or as a quoted string does.
_SPELLED = ((re.compile(r"""[^\s"'<>]+"""), ("%",)), (re.compile(r"""[^"'\n]+"""), ("\\x", "\\u00")))
_GZIP, _ZLIB, _DEFLATE = (lambda: zlib.decompressobj(31)), (lambda: zlib.decompressobj(15)), (lambda: zlib.decompressobj(-15))
#: How compressed streams begin. Fixed values.
_MAGIC = {
    b"\x1f\x8b\x08": _GZIP, b"\x78\x01": _ZLIB, b"\x78\x5e": _ZLIB, b"\x78\x9c": _ZLIB, b"\x78\xda": _ZLIB, b"BZh": bz2.BZ2Decompressor,
    b"\xfd7zXZ\x00": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), b"\x28\xb5\x2f\xfd": lambda: zstandard.ZstdDecompressor().decompressobj(),
}
_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)
#: What a layer must hold, in lower case and but for the words above, for a pattern, an escape or a base64 run to be in it.
_HINTS = (b"akia", b"%", b"\\x", b"\\u", b"&")
_LONG_RUN = re.compile(rb"[a-z0-9+/_-]{16}")
_SPACES = re.compile(rb"\x20{65,}")
#: Compressed bytes that are fed at once: what comes out of them is bounded.
STEP = 512
#: Bytes of a decompressed stream that are scanned at once, and those that a window repeats of the one before. Spans in
#: compressed layers map to the whole run, so a window only has to show that a pattern occurs.
WINDOW, OVERLAP = 32 << 20, 1 << 20


def find_base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in ``text``, leftmost and non-overlapping per kind, unsorted."""
    out = []
    low = text.lower()
    for kind, pattern, keep in _DETECT:
        if kind == "assign" and not any(w in low for w in _WORDS):
            continue
        for m in (_HEX_LONG if kind == "hex" else pattern).finditer(text):
            if keep(m):
                out.append((m.start(), m.end(), kind))
    return out


COPY, CODED, HIDDEN = range(3)


class Pieces:
    """Where the code points of a layer stand in the original text. A piece begins at ``at`` and is copied (code points from
    ``a`` on), coded (bytes from ``b`` on of base64 that begins at ``a``) or hidden (all of it stands for ``a`` to ``b``)."""

    def __init__(self, *rows: tuple[int, int, int, int]):
        self.at, self.rows = [r[0] for r in rows], [r[1:] for r in rows]

    def add(self, at: int, kind: int, a: int, b: int) -> None:
        self.at.append(at)
        self.rows.append((kind, a, b))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The original span of the layer's code points ``start`` to ``end`` (exclusive, not empty)."""
        i, k = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        kind, a, b = self.rows[i]
        low = a + start - self.at[i] if kind == COPY else a + (start - self.at[i] + b) * 4 // 3 if kind == CODED else a
        kind, a, b = self.rows[k]
        high = a + end - self.at[k] if kind == COPY else a + -(-(end - self.at[k] + b) * 4 // 3) if kind == CODED else b
        return low, high

    def copy(self, start: int, end: int, to: Pieces, at: int) -> None:
        """Add the pieces of code points ``start`` to ``end`` to another table, in which they begin at ``at``."""
        i = bisect_right(self.at, start) - 1
        while start < end:
            stop = min(end, self.at[i + 1]) if i + 1 < len(self.at) else end
            kind, a, b = self.rows[i]
            skip = start - self.at[i]
            to.add(at, kind, a + skip if kind == COPY else a, b + skip if kind == CODED else b)
            at, start, i = at + stop - start, stop, i + 1

    def copied(self, start: int, end: int) -> int | None:
        """The original position of ``start``, if all up to ``end`` is copied from there in one piece."""
        i = bisect_right(self.at, start) - 1
        kind, a, _ = self.rows[i]
        return a + start - self.at[i] if kind == COPY and (i + 1 == len(self.at) or self.at[i + 1] >= end) else None


@dataclass
class Layer:
    """A decoded text."""

    text: str
    pieces: Pieces
    level: int = 0  # of escapes that are undone

    def key(self) -> tuple:
        return hashlib.sha1(self.text.encode("utf-8", "surrogatepass")).digest(), self.pieces.span(0, max(1, len(self.text)))


@dataclass
class Data:
    """Decoded bytes. ``bare``: a deflate stream without a header may begin at the first."""

    data: bytes
    pieces: Pieces
    bare: bool = False

    def key(self) -> tuple:
        return hashlib.sha1(self.data).digest(), self.pieces.span(0, len(self.data)), self.bare


def _units(codes: list[int], size: int) -> Iterator[tuple[str, int]]:
    """(character, code points it took) of UTF-16 units that took ``size`` code points each."""
    i = 0
    while i < len(codes):
        pair = 0xD800 <= codes[i] < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1] < 0xE000
        yield chr(0x10000 + ((codes[i] - 0xD800) << 10) + codes[i + 1] - 0xDC00) if pair else chr(codes[i]), size * (1 + pair)
        i += 1 + pair


def _undone(m: re.Match) -> Iterator[tuple[str, int]]:
    """(new text, code points of the escape it replaces) for one match of _ESCAPE. Bytes that aren't UTF-8 become Latin-1."""
    kind, run = m.lastgroup, m[0]
    if kind == "percent":
        for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
            yield (chr(ord(c) - 0xDC00), 3) if "\udc80" <= c <= "\udcff" else (c, 3 * len(c.encode()))
    elif kind == "units":
        yield from _units([int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)], 6)
    elif kind == "name":
        yield _NAMED[m[kind]], len(run)
    else:
        code = int(m[kind], 10 if kind == "decimal" else 16)
        yield chr(code) if code <= 0x10FFFF else run, len(run)


def _spelled_sign(escape: str) -> str:
    """The sign that an escape spells."""
    digits = escape.rstrip(";}").lower()
    if digits.endswith("amp"):
        return "&"
    return chr(int(digits[-2:], 10 if "&#" in escape and "x" not in digits else 16))


def _sign(text: str, m: re.Match) -> tuple[str, int]:
    """The sign that a match spells, and its end. Where that sign begins an escape which spells a sign again, and so on
    (%252541), all levels are undone at once: between them nothing else comes to light."""
    end, sign = m.end(), _spelled_sign(m[0])
    while more := _MORE_SIGNS[sign].match(text, end):
        sign, end = _spelled_sign(sign + more[0]), more.end()
    return sign, end


def _settled(layer: Layer) -> Layer:
    """``layer`` with all levels of escapes undone, in one pass: whenever the end of what is read so far is an escape, it is replaced by
    what it spells, which may be the end of another. Bytes become Latin-1."""
    out: list[str] = []
    spans: list[tuple[int, int] | None] = []  # of what is spelled; None: copied
    starts: list[int] = []
    for i, c in enumerate(layer.text):
        out.append(c)
        spans.append(None)
        starts.append(i)
        while (c in ";}" or c in "0123456789abcdefABCDEF") and (m := _ENDING.search("".join(out[-10:]))):
            kind, digits = m.lastgroup, m[m.lastgroup]
            code = ord(_NAMED[digits]) if kind == "name" else int(digits, 10 if kind == "decimal" else 16)
            if code > 0x10FFFF:
                break
            n = m.end() - m.start()
            low = starts[-n]
            del out[-n:], spans[-n:], starts[-n:]
            c = chr(code)
            out.append(c)
            spans.append((low, i + 1))
            starts.append(low)
    pieces, before = Pieces(), -2
    for at, (span, start) in enumerate(zip(spans, starts, strict=True)):
        if span is not None:
            pieces.add(at, HIDDEN, *layer.pieces.span(*span))
            before = -2
        else:
            if start != before + 1:
                stop = at
                while stop + 1 < len(spans) and spans[stop + 1] is None and starts[stop + 1] == starts[stop] + 1:
                    stop += 1
                layer.pieces.copy(start, starts[stop] + 1, pieces, at)
            before = start
    return Layer("".join(out), pieces, layer.level + 1)


def _unescaped(layer: Layer) -> Layer | None:
    """The lines of ``layer`` that hold escapes, all of these undone; lines that don't follow each other are kept apart by a
    NUL. None if there are none."""
    text, old = layer.text, layer.pieces
    if "%" not in text and "\\" not in text and "&" not in text:
        return None
    out, pieces, size, last, stop = [], Pieces(), 0, 0, -1

    def keep(start: int, end: int) -> None:
        nonlocal size
        if end > start:
            old.copy(start, end, pieces, size)
            out.append(text[start:end])
            size += end - start

    changed = False
    at = 0
    while m := _ESCAPE.search(text, at):
        if m.start() >= stop:  # another line
            if stop >= 0:
                keep(last, stop)
                if (last := text.rfind("\n", 0, m.start()) + 1) > stop + 1:
                    pieces.add(size, HIDDEN, *old.span(stop, stop + 1))
                    out.append("\0")
                    size += 1
                else:
                    last = stop
            else:
                last = text.rfind("\n", 0, m.start()) + 1
            stop = text.find("\n", m.end())
            stop = len(text) if stop < 0 else stop
        keep(last, m.start())
        at = m.start()
        sign, end = _sign(text, m) if m["sign"] else ("", 0)
        for new, length in [(sign, end - at)] if sign else _undone(m):
            pieces.add(size, HIDDEN, *old.span(at, at + length))
            out.append(new)
            size, at = size + len(new), at + length
        last, changed = at, True
    if not changed:
        return None
    keep(last, stop)
    undone = Layer("".join(out), pieces, layer.level + 1)
    return _settled(undone) if undone.level == LEVELS else undone


def _base64(layer: Layer) -> Iterator[Data]:
    """The bytes of every base64 run (also over lines), from each of its first four code points on: a run may begin with
    something else that is made of the same characters, such as a path."""
    text, pieces = layer.text, layer.pieces

    def decoded(run: str, origin: int | None, start: int, end: int) -> Iterator[Data]:
        digits = run.translate(_STANDARD).encode()
        for skip in range(4):
            part = digits[skip : len(digits) - ((len(digits) - skip) % 4 == 1)]
            if data := binascii.a2b_base64(part + b"=" * (-len(part) % 4)):
                yield Data(data, Pieces((0, HIDDEN, *pieces.span(start, end))) if origin is None else Pieces((0, CODED, origin + skip, 0)), bare=True)

    joined = -1
    for m in _BASE64.finditer(text):
        start, end = m.span()
        yield from decoded(m[0], pieces.copied(start, end), start, end)
        if start < joined:
            continue
        joined, width = end, end - start
        while width == end - start and (more := _MORE.match(text, joined)) and (width := more.end(1) - more.start(1)) <= end - start:
            joined = more.end()
        if joined > end:
            yield from decoded(re.sub(r"\s", "", text[start:joined]), None, start, joined)


_STANDARD = str.maketrans("-_", "+/")


def _spelled(layer: Layer) -> Iterator[Data]:
    """What compressed streams hold among the bytes that stretches with escapes spell. (As text, escapes are undone by
    _unescaped.)"""
    text = layer.text
    for pattern, marks in _SPELLED:
        if not any(k in text for k in marks):
            continue
        for m in pattern.finditer(text):
            if not any(k in m[0] for k in marks):
                continue
            run = m[0].encode("latin-1", "replace")
            if marks == ("%",):
                found = {urllib.parse.unquote_to_bytes(run), urllib.parse.unquote_to_bytes(run.replace(b"+", b" "))}
            else:
                found = {run.decode("unicode_escape", "replace").encode("latin-1", "replace")}
            for data in sorted(found - {run}):
                if _compressed(data):
                    yield from _streams(Data(data, Pieces((0, HIDDEN, *layer.pieces.span(*m.span())))))


def _compressed(data: bytes) -> bool:
    return any(magic in data for magic in _MAGIC)


def _fed(d, data: bytes, start: int, end: int, step: int) -> Iterator[bytes]:
    for at in range(start, end, step):
        yield d.decompress(data[at : min(end, at + step)])
        if d.eof:
            return


def _inflated(make, data: bytes, start: int) -> Iterator[bytes]:
    """What a stream that begins at ``start`` yields, up to its end, a fault or the end of ``data``. Returns the position
    after a complete stream, else None."""
    d, good = make(), start
    try:
        for out in _fed(d, data, start, len(data), STEP):
            yield out
            good = min(len(data), good + STEP)
    except _BROKEN:
        if good + 1 < len(data):  # what comes before the fault in this step
            d = make()
            try:
                for _ in _fed(d, data, start, good, STEP):
                    pass
                yield from _fed(d, data, good, len(data), 1)
            except _BROKEN:
                pass
        return None
    return good - len(d.unused_data) if d.eof else None


def _whole_deflate(data: bytes) -> bool:
    """Whether a complete deflate stream without a header begins the bytes. Without a magic number, most bytes begin one
    that breaks off, so these count only if they come to their end."""
    d = _DEFLATE()
    try:
        for _ in _fed(d, data, 0, len(data), STEP):
            pass
    except _BROKEN:
        return False
    return d.eof


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks joined to windows, each with the end of the one before. Long runs of spaces are shortened in large streams,
    as patterns take any number of them."""
    held: list[bytes] = []
    size, first = 0, True
    for c in chunks:
        if c:
            held.append(c)
            size += len(c)
        if size >= WINDOW:
            window = b"".join(held)
            yield window
            tail = _SPACES.sub(b" " * 64, window[-OVERLAP * 8 :])[-OVERLAP:]
            held, size, first = [tail], len(tail), False
    if size and (first or len(held) > 1):
        yield b"".join(held)


def _streams(node: Data) -> Iterator[Data]:
    """Windows of what compressed streams hold, wherever they begin in the bytes."""
    data, whole = node.data, node.pieces.span(0, len(node.data))

    def opened(make, start: int):
        ended = None

        def chunks():
            nonlocal ended
            ended = yield from _inflated(make, data, start)

        for window in _windows(chunks()):
            yield Data(window, Pieces((0, HIDDEN, *whole)))
        return ended

    if node.bare and _whole_deflate(data):
        yield from opened(_DEFLATE, 0)
    at, begins = 0, {magic: data.find(magic) for magic in _MAGIC}
    while found := [(x, magic) for magic, x in begins.items() if x >= 0]:
        start, magic = min(found)
        at = (yield from opened(_MAGIC[magic], start)) or start + 1
        for m, x in begins.items():
            if 0 <= x < at:
                begins[m] = data.find(m, at)


def _promising(data: bytes) -> bool:
    low = data.lower()
    return any(w in low for w in _HINTS) or any(w.encode() in low for w in _WORDS) or _LONG_RUN.search(low) is not None


def _below(node: Layer | Data) -> Iterator[Layer | Data]:
    """The layers below, but for the unescaped one."""
    if isinstance(node, Layer):
        yield from _base64(node)
        yield from _spelled(node)
        return
    if _promising(node.data):
        yield Layer(node.data.decode("latin-1"), node.pieces)
    if b"\0" in node.data:
        bare = node.data.replace(b"\0", b"")
        if _promising(bare):
            yield Layer(bare.decode("latin-1"), Pieces((0, HIDDEN, *node.pieces.span(0, len(node.data)))))
    yield from _streams(node)


def layers(text: str) -> Iterator[Layer]:
    """``text`` and all layers below it, each once for a stretch of the text. The stack holds layers and, for those that are
    open, iterators over what is below them."""
    seen: set[tuple] = set()
    work: list = [Layer(text, Pieces((0, COPY, 0, 0)))]
    while work:
        node = work.pop()
        if not isinstance(node, (Layer, Data)):
            if (child := next(node, None)) is not None:
                work += [node, child]
            continue
        if isinstance(node, Layer) or _compressed(node.data):  # other bytes only lead to layers, which are checked
            if (key := node.key()) in seen:
                continue
            seen.add(key)
        if isinstance(node, Layer):
            yield node
            if (more := _unescaped(node)) is not None:
                work.append(more)
        work.append(_below(node))


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], set[tuple[int, int, str]]]:
    """Base spans of ``text``, sorted, and the spans that decoded layers add; all as (start, end, kind) in code points of
    ``text``. A span in an unescaped or base64 layer covers the escapes and base64 digits that spell it; what comes from a
    compressed stream, from base64 over lines or from UTF-16 covers the whole run."""
    text = text or ""
    base = sorted(find_base(text), key=lambda x: (x[0], KINDS.index(x[2])))
    known, added = set(base), set()
    found = layers(text)
    next(found)
    for layer in found:
        for s, e, kind in find_base(layer.text):
            if (span := (*layer.pieces.span(s, e), kind)) not in known:
                added.add(span)
    return base, added


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """``text`` with every found span replaced by ``mark`` (overlapping spans by one)."""
    if not text:
        return text
    base, added = scan(text)
    out, last = [], 0
    for s, e, _ in sorted({*base, *added}):
        if e > last:
            if s >= last:
                out += [text[last:s], mark]
            last = e
    return "".join([*out, text[last:]])


def _row():
    def one(doc_id, text):
        base, added = scan(text)
        n = [sum(k == kind for _, _, k in base) for kind in KINDS]
        return doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *added]), len(added)

    return one


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added for every row of ``docs``.

    Whole texts are scanned, a null text counts as empty; rows are independent, so repeated rows give repeated results
    and a null doc_id stays null. Counts and hash are those of the base spans, ``spans`` also has those of decoded
    layers. Other columns are not read.
    """
    return map_rows(docs.select("doc_id", "text"), _row, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts have a mark in place of every secret. A column n_chars gets
    the new text's length. Null texts stay null."""
    name = "factgraph_masked_text"
    out = append_columns(docs, ["text"], lambda: lambda text: (redact(text),), f"{name} string")
    changed = {"text": F.col(name)} | ({"n_chars": F.when(F.col(name).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(name))} if "n_chars" in docs.columns else {})
    return out.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in docs.columns))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
