"""Secret scans through nested encodings.

Each text is a layer.  A worklist takes a layer, finds secrets in it, and unwraps what looks encoded in it into new layers
until nothing is new: a layer seen before, by its content and place, is not taken up again, so cycles end.  Unwrapped are

* URL escapes (``%41``, ``%u0041``) and the escapes of strings and markup (``\\u0041``, ``\\u{41}``, ``\\U00000041``, ``\\x41``,
  ``\\101``, ``&#65;``, ``&#x41;``, ``&equals;``) of the whole layer;
* runs of base64, plain or URL-safe, in all four alignments, so that what stands before a code does no harm, and also
  joined over line breaks, however short the lines;
* ASCII in two or four bytes a sign (UTF-16, UTF-32, either order);
* gzip (all members) and zlib data of any window in every layer, and raw deflate data at any byte of a decoded layer.

Layers of bytes are read as Latin-1: every sign of a secret is ASCII, so nothing depends on what text the bytes are.  Every
character of a layer carries the span of the whole text that it came from, so a secret found at any depth is reported as
the span of its outermost encoded form: of the escapes or groups of base64 that hold it, or of all of a compressed stream.

Raw deflate has no mark of its own.  It is tried wherever the bits can begin a block (a stored length and its complement, a
whole set of code lengths, or a literal in the fixed code) and one of the next 32 bytes is no printable ASCII, which compressed
data miss less than once in 10^13 times.  A start before the true one may fall into step with it, so others are tried too, but none
within a stream of more than 512 bytes or 64 KB of output, and none counts that gives just the end of what another gave.

Decompressed layers have no limit: they are inflated and scanned in windows of 4 MB that overlap, and a stream that goes on over
the end of its window is read on from there, at any depth.  Memory is some windows a level.  A window that was seen before at its
place is not scanned again, so what repeats (the filling of an archive that was made to burst) costs its inflating alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Fixed patterns of the three kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Only where 24 hexadecimal digits stand together can a match be long enough; it is then widened to the whole run.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

URL_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|%[uU]([0-9A-Fa-f]{4})")
UNICODE_ESCAPE = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\[ux]\{([0-9A-Fa-f]{1,6})\}|\\([0-3][0-7]{2}|[0-7]{2})"
    r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&([A-Za-z]{2,24});"
)
#: Entities that stand for one ASCII sign.
NAMED = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";") and len(sign) == 1 and sign.isascii()}
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A code over several lines.  It begins where a run does, and gives nothing back, so that a long line is read once.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BASE64_LEAST = 16
#: ASCII signs with one or three zero bytes between them.
WIDE = re.compile("\0{0,3}(?:[\t\n\r -~]\0(?:\0\0)?){5,}[\t\n\r -~]?")
#: Where gzip and zlib data begin: of the two bytes of a zlib header the first names the method and the window, and both
#: together are a multiple of 31 (without a preset dictionary, which nothing here could supply).
ZLIB = {chr(a): "".join(chr(b) for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 32) for a in range(8, 128, 16)}
PACKED = re.compile("\x1f\x8b\x08|(?=[" + "".join(ZLIB) + "])(?:" + "|".join(f"{re.escape(a)}[{re.escape(b)}]" for a, b in ZLIB.items()) + ")")
_STANDARD = str.maketrans("-_", "+/")
_CODE_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
#: Decompressed layers are scanned in windows of WINDOW bytes, each with the last OVERLAP of the one before.
WINDOW, OVERLAP = 1 << 22, 1 << 16
#: Raw deflate data have a byte beyond printable ASCII among this many; a try that runs for as many as RAN is a stream.
ODD_WITHIN, RAN = 32, 512
#: The shortest secret, a key and six characters, takes as many bytes of raw deflate at least.
LEAST_RAW = 12
#: Bytes that are looked at together for starts of raw deflate.
STARTS = 1 << 16

#: Bytes after a place in a layer that its window no longer holds.
Rest = Callable[[], Iterator[bytes]]
#: (start, end) in the layer of each character, or the one span of all of them.
Spans = np.ndarray | tuple[int, int]
#: (text, its spans in the layer that it was encoded in, what follows its window, whether its characters are decoded bytes).
Layer = tuple[str, Spans, Rest | None, bool]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets that stand in ``text`` itself."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return found


#: What an encoded secret or a secret needs at least; texts without any of it cannot hold one.
_CUE = (
    r"%[uU]?[0-9A-Fa-f]{2}|\\[uxU][0-9A-Fa-f{]{2}|\\[0-7]{2}|&#[0-9xX]|&[A-Za-z]{2,24};|[A-Za-z0-9+/_=-]{16}|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]"
    "|[\t\n\r -~]\0"
    r"|[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
CUE, LAYER_CUE = re.compile(_CUE.encode()), re.compile(_CUE)


def _literals() -> np.ndarray:
    """Of nine bits of the fixed code of deflate, the first to come in the lowest place: do they begin with a literal?"""
    bits = np.array([int(f"{i:09b}"[::-1], 2) for i in range(512)])
    return (bits >> 2 > 0b0010111) & ~((bits >> 1 >= 0b11000000) & (bits >> 1 <= 0b11000111))


_LITERAL = _literals()


def _raw_starts(data: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Places of ``data`` (bytes) where a block of raw deflate can begin that has one of the ``odd`` bytes soon."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    sums = np.concatenate([[0], np.cumsum(odd)])
    at = np.flatnonzero((sums[np.minimum(np.arange(n) + ODD_WITHIN, n)] > sums[:-1]) & (data & 6 != 6))
    kind = data[at] >> 1 & 3
    head = sum(padded[at + i] << np.uint64(8 * i) for i in range(5)) if len(at) else np.zeros(0, np.uint64)
    stored = (kind == 0) & ((head >> np.uint64(8) ^ head >> np.uint64(24)) & np.uint64(0xFFFF) == 0xFFFF)
    fixed = (kind == 1) & _LITERAL[(head >> np.uint64(3) & np.uint64(511)).astype(np.int64)]
    good = stored | fixed
    dynamic = np.flatnonzero((kind == 2) & (head >> np.uint64(3) & np.uint64(31) <= 29) & (head >> np.uint64(8) & np.uint64(31) <= 29))
    if len(dynamic):
        codes = (head[dynamic] >> np.uint64(13) & np.uint64(15)).astype(np.int64) + 4
        lengths = sum(padded[at[dynamic] + 2 + i] << np.uint64(8 * i) for i in range(8)) >> np.uint64(1)
        share = np.zeros(len(dynamic), np.int64)
        for i in range(19):
            length = (lengths >> np.uint64(3 * i) & np.uint64(7)).astype(np.int64)
            share += np.where((i < codes) & (length > 0), 128 >> length, 0)
        good[dynamic[share == 128]] = True
    return at[good]


class _Inflating:
    """Decompresses ``source`` in pieces; all members of gzip.  ``used`` are the bytes read, ``whole`` says that the end of
    the stream was met.  Of a broken stream, what was right."""

    def __init__(self, source: Iterator[bytes], bits: int) -> None:
        self.source, self.bits, self.used, self.whole, self.broken = source, bits, 0, False, False

    def __iter__(self) -> Iterator[bytes]:
        unpack, data = zlib.decompressobj(self.bits), b""
        while True:
            if not data and not (data := next(self.source, b"")):
                return
            try:
                out = unpack.decompress(data, STARTS)
            except zlib.error:
                self.broken = True
                return
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            self.used += len(data) - len(left)
            data = left
            if out:
                yield out
            if unpack.eof:
                self.whole = True
                if self.bits != 31:
                    return
                if len(data) < 2:
                    data += next(self.source, b"")
                if data[:2] != b"\x1f\x8b":
                    return
                unpack = zlib.decompressobj(self.bits)


def _feed(data: memoryview, rest: Rest | None) -> Iterator[bytes]:
    """``data`` in pieces, small ones first, since most tries end soon; then what follows it."""
    at, size = 0, 64
    while at < len(data):
        yield bytes(data[at : at + size])
        at, size = at + size, 4096
    if rest is not None:
        yield from rest()


def _after(pieces: Iterator[bytes], gone: int) -> Iterator[bytes]:
    for piece in pieces:
        if gone < len(piece):
            yield piece[gone:]
        gone = max(0, gone - len(piece))


def _windows(pieces: Iterator[bytes], again: Callable[[], Iterator[bytes]]) -> Iterator[tuple[bytes, Rest | None]]:
    """(bytes, what follows them) of the windows of a layer; ``again`` inflates the layer anew."""
    held, begin = bytearray(), 0
    for piece in pieces:
        held += piece
        if len(held) > WINDOW:
            end = begin + len(held)
            yield bytes(held), lambda end=end: _after(again(), end)
            del held[:-OVERLAP]
            begin = end - OVERLAP
    if held and (begin == 0 or len(held) > OVERLAP):
        yield bytes(held), None


def _one(m: re.Match[str]) -> str | None:
    four, two, eight, braced, octal, decimal, hexa, name = m.groups()
    if name:
        return NAMED.get(name)
    code = int(octal, 8) if octal else int(decimal) if decimal else int(four or two or eight or braced or hexa, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _replaced(text: str, found: list[tuple[int, int, str]]) -> tuple[str, np.ndarray]:
    """``text`` with each (start, end, character) in place of what it spans, and the (start, end) in ``text`` of every
    character of the result."""
    out, at, ends, keep = [], 0, np.arange(1, len(text) + 1), np.ones(len(text), bool)
    for start, end, char in found:
        out += [text[at:start], char]
        keep[start + 1 : end] = False
        ends[start] = end
        at = end
    starts = np.flatnonzero(keep)
    return "".join([*out, text[at:]]), np.stack([starts, ends[starts]], axis=1)


def _codes(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Runs of base64 without their padding, with the place of each sign: each by itself, then those that line breaks part
    as one."""
    for m in BASE64_RUN.finditer(text):
        run = m[0].rstrip("=")
        yield run, np.arange(m.start(), m.start() + len(run))
    for m in BASE64_LINES.finditer(text) if "\n" in text else ():
        run = "".join(m[0].split()).rstrip("=")
        if len(run) >= BASE64_LEAST:
            signs = np.frombuffer(m[0].rstrip("=").encode("ascii"), np.uint8)
            yield run, m.start() + np.flatnonzero((signs != 9) & (signs != 10) & (signs != 13) & (signs != 32))


def _opened(data: memoryview, at: int, bits: int, rest: Rest | None) -> Iterator[tuple[bytes, Rest | None, int]]:
    """(window, what follows it, bytes of ``data`` that the whole stream takes) of what is compressed at ``at``."""

    def fresh() -> _Inflating:
        return _Inflating(_feed(data[at:], rest), bits)

    stream, used = fresh(), None
    for window, more in _windows(iter(stream), lambda: iter(fresh())):
        if used is None and more is not None:  # all windows get one span, so the stream's end is looked for first
            whole = fresh()
            for _ in whole:
                pass
            used = whole.used
        yield window, more, min(stream.used if used is None else used, len(data) - at)


def _packed(text: str, odd: np.ndarray | None, rest: Rest | None) -> Iterator[tuple[str, Spans, Rest | None]]:
    """What is compressed in ``text``: gzip and zlib anywhere, raw deflate at bytes from which an ``odd`` one is near (None: it
    is not sought)."""
    found = PACKED.search(text)
    if odd is not None and (len(text) < LEAST_RAW or not odd.any()):
        odd = None
    if not found and odd is None:
        return
    data = text.encode("latin-1", "replace")  # a byte a character
    view, past = memoryview(data), []
    while found:
        at, used = found.start(), 0
        for window, more, used in _opened(view, at, 31 if found[0][0] == "\x1f" else 15, rest):
            yield window.decode("latin-1"), (at, max(found.end(), at + used)), more
        if used:
            past.append((at, at + used))
        found = PACKED.search(text, max(at + 1, at + used))
    if odd is None:
        return
    whole, end = np.frombuffer(data, np.uint8), 0
    given: list[tuple[int, bytes]] = []  # (end, all bytes) of short streams that reach to here
    for begin in range(0, len(data), STARTS):
        stop = begin + STARTS
        starts = _raw_starts(whole[begin : stop + 64], odd[begin : stop + 64])
        for at in (begin + starts[starts < STARTS]).tolist():
            while past and past[0][1] <= at:
                past.pop(0)
            if at < end or (past and past[0][0] <= at):
                continue
            unpack = zlib.decompressobj(-15)
            try:
                out = unpack.decompress(view[at : at + RAN], STARTS)
            except zlib.error:
                continue
            if unpack.eof:
                used = min(RAN, len(data) - at) - len(unpack.unused_data)
                given = [g for g in given if g[0] > at]
                if len(out) < LEAST["assign"] + 4 or any(e == at + used and longer.endswith(out) for e, longer in given):
                    continue
                given.append((at + used, out))
                windows = iter([(out, None, used)])
            elif len(data) - at > RAN or rest is not None or unpack.unconsumed_tail:
                windows = _opened(view, at, -15, rest)
            else:
                continue
            for window, more, used in windows:
                layer = window.decode("latin-1")
                if _worth(layer) or _odd(layer).any():
                    yield layer, (at, at + used), more
            if not unpack.eof:
                end = max(end, at + used)


def _odd(text: str) -> np.ndarray:
    """Which characters are bytes beyond printable ASCII."""
    data = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return ((data < 32) & (data != 9) & (data != 10) & (data != 13)) | (data > 126)


def _worth(layer: str) -> bool:
    return LAYER_CUE.search(layer) is not None or PACKED.search(layer) is not None


def _through(outer: Spans | None, inner: Spans) -> Spans:
    """``inner`` spans of a layer as spans of what the layer's own ``outer`` spans are of."""
    if outer is None or isinstance(outer, tuple):
        return inner if outer is None else outer
    if isinstance(inner, tuple):
        part = outer[inner[0] : inner[1]]
        return int(part[:, 0].min()), int(part[:, 1].max())
    return np.stack([outer[inner[:, 0], 0], outer[inner[:, 1] - 1, 1]], axis=1)


def unwrap(text: str, decoded: bool, rest: Rest | None = None) -> Iterator[Layer]:
    """All that is encoded in ``text``, with its spans in it.  ``decoded``: the text is of bytes that a decoding gave."""
    if "%" in text:
        yield from _unescaped(text, [(m.start(), m.end(), chr(int(m[1] or m[2], 16))) for m in URL_ESCAPE.finditer(text)])
    if "\\" in text or "&" in text:
        yield from _unescaped(text, [(m.start(), m.end(), c) for m in UNICODE_ESCAPE.finditer(text) if (c := _one(m)) is not None])
    if "\0" in text:
        keep = np.ones(len(text), bool)
        for m in WIDE.finditer(text):
            keep[m.start() : m.end()] = [sign != "\0" for sign in m[0]]
        if not keep.all():
            at = np.flatnonzero(keep)
            yield "".join(text[i] for i in at.tolist()), np.stack([at, at + 1], axis=1), None, False
    for run, places in _codes(text):
        plain = run.translate(_STANDARD)
        for shift in range(4):
            code = plain[shift:]
            code = code[: len(code) - (len(code) % 4 == 1)]
            data = base64.b64decode(code + "=" * (-len(code) % 4))
            if len(data) < 6:
                continue
            dec = data.decode("latin-1")
            at = shift + np.arange(len(data)) // 3 * 4
            spans = np.stack([places[at], places[np.minimum(at + 3, len(places) - 1)] + 1], axis=1)
            if _worth(dec):
                yield dec, spans, None, True
            else:  # nothing but raw deflate can be in it
                yield from ((out, _through(spans, part), more, True) for out, part, more in _packed(dec, _odd(dec), None))
    yield from ((out, part, more, True) for out, part, more in _packed(text, _odd(text) if decoded else None, rest))


def _unescaped(text: str, found: list[tuple[int, int, str]]) -> Iterator[Layer]:
    """The layer of ``text`` with what it escapes, and what is deflated in it: only what escapes stand for is taken for bytes."""
    if found:
        layer, spans = _replaced(text, found)
        yield layer, spans, None, False
        odd = _odd(layer) & (spans[:, 1] - spans[:, 0] > 1)
        yield from ((out, _through(spans, part), more, True) for out, part, more in _packed(layer, odd, None))


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], bool]:
    """(base, all, cut): spans of ``text`` as (start, kind, end); all has the base ones and what nested layers add, each
    span once; cut: a code in base64 in a compressed layer went on over the end of a window, so that it was decoded in
    parts.  Null and empty texts have none."""
    if not text:
        return [], [], False
    base = base_spans(text)
    found, cut = set(base), False
    seen = {_key(text, (0, 0))}
    work: list[tuple[Iterator[Layer], Spans | None]] = [(unwrap(text, False), None)]
    while work:
        layers, outer = work[-1]
        if (one := next(layers, None)) is None:
            work.pop()
            continue
        layer, inner, rest, decoded = one
        spans = _through(outer, inner)
        if (key := _key(layer, spans)) in seen:
            continue
        seen.add(key)
        if not _worth(layer) and not (decoded and _odd(layer).any()):
            continue
        for start, kind, end in base_spans(layer):
            start, end = _through(spans, (start, end))
            found.add((start, kind, end))
        cut |= rest is not None and _CODE_SIGNS.issuperset(layer[-OVERLAP:])
        work.append((unwrap(layer, decoded, rest), spans))
    return base, sorted(found, key=_order), cut


def _key(layer: str, spans: Spans) -> bytes:
    place = np.asarray(spans if isinstance(spans, tuple) else spans[[0, -1]]).tobytes()
    return hashlib.blake2b(layer.encode("utf-8", "surrogatepass") + place, digest_size=16).digest()


def _order(span: tuple[int, str, int]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=_order))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, cut) of every row of ``docs`` (doc_id, text; other columns,
    whatever their names, are not looked at).

    The counts and the digest are of the secrets in the text itself, ``spans`` also has those of nested layers,
    in code points; ``cut`` says that a code in base64 in a compressed layer was longer than a window, and so decoded in parts.  Null and
    empty texts have none: zeros, the digest of nothing, no spans.  A null doc_id stays null, repeated rows repeat, an empty
    table gives an empty one; texts of any length are scanned whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.bool_()]
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                base, full, cut = scan(data.decode("utf-8", "replace")) if data and CUE.search(data) else ([], [], False)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(full), cut))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "cut"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(tidy(each), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, cut boolean")
