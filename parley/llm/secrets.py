"""Secret scan with a recursive decoding worklist.

Each text is scanned with the base patterns; then every layer that the text
wraps (URL escapes, Unicode escapes, base64 tokens, compressed bytes inside
base64) is unwrapped, scanned in turn, and unwrapped again until nothing new
appears. A decoded layer keeps, for each of its code points, the span of the
original text it came from, so a hit in any layer is reported where it stands
in the original.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parley.llm.common import id_in, id_out, text_or_empty

KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))"
                     r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNI = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_UNI_ONE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 below one another: of one length but the last, which may be
#: shorter. Line ends may be escaped, lines indented or quoted ("> ").
_BREAK = r"[\x20\t]*(?:\r\n|\n|\r|\\r\\n|\\n)[\x20\t>]*"
_B64_LINE = re.compile(r"\\[rn]|[A-Za-z0-9+/_-]+={0,2}")
_B64_BREAK = re.compile(_BREAK)
_B64_END = re.compile(r"\n|\r|\\[rn]")
_B64_TAIL = re.compile(r"[A-Za-z0-9+/_-]{16}={0,2}\Z")
#: Printable runs of bytes that are no clean text are scanned if this long: the
#: shortest hit ("token=" and six characters) has that many, wrapped ones more.
MIN_RUN = 12
#: Inflated bytes are read in windows of WINDOW, each with the last OVERLAP bytes
#: of the one before, so a layer of any size is read in bounded memory.
WINDOW, OVERLAP = 1 << 26, 1 << 20

_ODD = re.compile(r"[\x00-\x08\x0e-\x1f]")
_PLAIN = re.compile(r"[\t-\r\x20-\x7e]{%d,}" % MIN_RUN)
_PLAIN_16 = re.compile(r"(?:[\t-\r\x20-\x7e]\x00){%d,}|(?:\x00[\t-\r\x20-\x7e]){%d,}" % (MIN_RUN, MIN_RUN))

Span = tuple[int, int, int]  # start, end, index of the kind


def scan(text: str) -> list[Span]:
    """The base patterns: leftmost, non-overlapping within each kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text with the original span of each of its code points (None for the
    original itself, whose code points stand for themselves)."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def behind(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends in the original for pieces from one code point to another."""
        if self.starts is None:
            return first, last + 1
        return self.starts[first], self.ends[last]

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text), dtype=np.int64)
            return at, at + 1
        return self.starts, self.ends

    def replaced(self, parts: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
        """With [start, end) of each part put as its text; the last field has
        the span in this layer behind each code point put."""
        starts, ends = self.maps()
        text, s, e, at = [], [], [], 0
        for a, b, put, spans in parts:
            text += [self.text[at:a], put]
            s.append(starts[at:a])
            e.append(ends[at:a])
            if put:
                s.append(np.array([starts[x:y].min() for x, y in spans], dtype=np.int64))
                e.append(np.array([ends[x:y].max() for x, y in spans], dtype=np.int64))
            at = b
        text.append(self.text[at:])
        s.append(starts[at:])
        e.append(ends[at:])
        return Layer("".join(text), np.concatenate(s), np.concatenate(e))


def _utf8_spans(raw: bytes, width: int, start: int) -> tuple[str, list[tuple[int, int]]]:
    """Decoded text of ``raw`` (wrong bytes replaced) and, for each code point,
    the span of the escapes of ``width`` characters it came from."""
    out, spans, i = [], [], 0
    while i < len(raw):
        n = next((k for k in (1, 2, 3, 4) if _valid(raw[i:i + k])), 0)
        out.append(raw[i:i + n].decode() if n else "�")
        spans.append((start + i * width, start + (i + (n or 1)) * width))
        i += n or 1
    return "".join(out), spans


def _valid(piece: bytes) -> bool:
    try:
        return len(piece.decode()) == 1
    except UnicodeDecodeError:
        return False


def _unwrap_url(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    parts = []
    for m in _URL.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        put, spans = _utf8_spans(raw, 3, m.start())
        parts.append((m.start(), m.end(), put, spans))
    return layer.replaced(parts) if parts else None


def _unwrap_unicode(layer: Layer) -> Layer | None:
    if "\\" not in layer.text:
        return None
    parts = []
    for m in _UNI.finditer(layer.text):
        put, spans, high = [], [], None
        for one in _UNI_ONE.finditer(layer.text, m.start(), m.end()):
            code = int(one[1] or one[2] or one[3], 16)
            if high is not None and 0xDC00 <= code < 0xE000:
                code = 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00
                put.pop()
                spans[-1] = (spans[-1][0], one.end())
            else:
                spans.append((one.start(), one.end()))
            high = code if 0xD800 <= code < 0xDC00 else None
            put.append("�" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code))
        parts.append((m.start(), m.end(), "".join(put), spans))
    return layer.replaced(parts) if parts else None


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """What decoded bytes may say: texts, and the first and the last byte of
    each of their code points.

    Clean UTF-8 is one text. Of other bytes, each run of ``MIN_RUN`` or more
    printable ASCII characters is one, as bytes or as UTF-16 of either order:
    all patterns and wrappings are ASCII, and so the same in UTF-8, Latin-1 and
    other supersets of it."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = None
    if text is not None and not _ODD.search(text):
        if text:
            end = np.cumsum(_utf8_width(text))
            yield text, end - _utf8_width(text), end - 1
        return
    latin = raw.decode("latin-1")
    for m in _PLAIN.finditer(latin):
        at = np.arange(m.start(), m.end(), dtype=np.int64)
        yield m[0], at, at
    for m in _PLAIN_16.finditer(latin):  # as big or as little endian, by the zeros' side
        odd = int(m[0][0] == "\0")
        at = np.arange(m.start() + odd, m.end(), 2, dtype=np.int64)
        yield m[0][odd::2], at, at


def _utf8_width(text: str) -> np.ndarray:
    size = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return 1 + (size > 0x7F) + (size > 0x7FF) + (size > 0xFFFF).astype(np.int64)


#: Starts of gzip, zlib and bzip2 streams.
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]\x31\x41\x59\x26\x53\x59", re.S)


def _gzip_header(raw: bytes, at: int) -> int:
    """Where the data of the gzip member at ``at`` start."""
    if len(raw) < at + 10:
        return len(raw)
    flags, pos = raw[at + 3], at + 10
    if flags & 4:
        pos += 2 + int.from_bytes(raw[pos:pos + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            end = raw.find(b"\0", pos)
            pos = len(raw) if end < 0 else end + 1
    return pos + 2 if flags & 2 else pos


def _inflated(raw: bytes, start: int, make) -> Iterator[tuple[bytes, int]]:
    """Windows of the stream whose data start at ``start``, and where it ends: 0
    with all but the last window, and if it breaks off or does not end. What
    comes before a fault is told; checksums are not looked at."""
    stream, held, pos, fresh = make(), b"", start, False
    try:
        while not stream.eof:
            rest = getattr(stream, "unconsumed_tail", b"")
            if not rest and pos < len(raw) and getattr(stream, "needs_input", True):
                rest, pos = raw[pos:pos + (1 << 16)], pos + (1 << 16)
            room = WINDOW - len(held)
            more = stream.decompress(rest, room)
            if not more and not rest:
                break
            held, fresh = held + more if held else more, fresh or bool(more)
            if len(held) >= WINDOW:
                yield held, 0
                held, fresh = held[-OVERLAP:], False
    except (zlib.error, OSError, ValueError):
        pass
    end = min(pos, len(raw)) - len(stream.unused_data) if stream.eof else 0
    if fresh:
        yield held, end


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """Windows of all compressed streams in some bytes: gzip members, zlib and
    bzip2 streams wherever they start, and bytes that are one raw deflate stream."""
    import bz2
    raw_deflate = lambda: zlib.decompressobj(-15)
    pos, found = 0, False
    while m := _PACKED.search(raw, pos):
        pos = m.start() + 1
        kind = raw[m.start()]
        start = _gzip_header(raw, m.start()) if kind == 0x1F else m.start() + 2 if kind == 0x78 else m.start()
        for window, end in _inflated(raw, start, bz2.BZ2Decompressor if kind == 0x42 else raw_deflate):
            found = True
            yield window
            pos = max(pos, end)
    if not found and len(raw) > 8:
        windows = _inflated(raw, 0, raw_deflate)
        first = next(windows, None)
        if first is not None and (first[1] == len(raw) or first[1] == 0 and len(first[0]) >= WINDOW):
            yield first[0]
            yield from (w for w, _ in windows)


def _tokens(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 tokens and where each of their characters is: unbroken runs, and
    runs of lines below one another that are joined."""
    for m in _B64.finditer(text):
        yield m[0], np.arange(m.start(), m.end(), dtype=np.int64)
    if not any(_ends_a_line(text, m.start()) for m in _B64_END.finditer(text)):
        return
    lines: list[tuple[int, int]] = []
    for m in _B64_LINE.finditer(text):
        if m[0][0] == "\\":  # an escaped line end: its letter is not of the line
            continue
        if lines and _B64_BREAK.fullmatch(text, lines[-1][1], m.start()):
            first, last = lines[0][1] - lines[0][0], lines[-1][1] - lines[-1][0]
            if last == first and m.end() - m.start() <= first and text[lines[-1][1] - 1] != "=":
                lines.append((m.start(), m.end()))
                continue
        yield from _wrapped(text, lines)
        lines = [(m.start(), m.end())]
    yield from _wrapped(text, lines)


def _ends_a_line(text: str, at: int) -> bool:
    """Whether a line of base64 ends at the line break there."""
    while at and text[at - 1] in "\x20\t":
        at -= 1
    return _B64_TAIL.search(text, max(0, at - 18), at) is not None


def _wrapped(text: str, lines: list[tuple[int, int]]) -> Iterator[tuple[str, np.ndarray]]:
    if sum(b - a - text.count("=", a, b) for a, b in lines) % 4 == 1:  # the last is a word that follows
        lines = lines[:-1]
    if len(lines) > 1 and lines[0][1] - lines[0][0] >= 16:
        yield "".join(text[a:b] for a, b in lines), np.concatenate([np.arange(a, b, dtype=np.int64) for a, b in lines])


def _unwrap_base64(layer: Layer) -> Iterator[Layer | Packed]:
    """What base64 tokens say. A token may begin with characters that are not of
    it (a path, a name) and end with one too many, so it is read from each of
    its first four characters: one of these readings is in step."""
    for found, at in _tokens(layer.text):
        token = found.rstrip("=").replace("-", "+").replace("_", "/")
        for step in range(4):
            std = token[step:len(token) - ((len(token) - step) % 4 == 1)]
            if len(std) < 16 - 4:
                continue
            try:
                raw = base64.b64decode(std + "=" * (-len(std) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            clean = False
            for text, low, high in _texts(raw):
                # Byte i is in the characters 4 * (i // 3) + i % 3 and the next one.
                first = at[step + 4 * (low // 3) + low % 3]
                last = at[np.minimum(step + 4 * (high // 3) + high % 3 + 1, len(at) - 1)]
                clean |= len(low) == len(raw)
                yield Layer(text, *layer.behind(first, last))
            if not clean:
                yield Packed(raw, *layer.origin(int(at[0]), int(at[-1]) + 1))


@dataclass(frozen=True)
class Packed:
    """Bytes that may hold compressed streams, and the original span of the
    token they are in."""

    raw: bytes
    start: int
    end: int

    def layers(self) -> Iterator[Layer | Packed]:
        for window in _unpacked(self.raw):
            clean = False
            for text, low, _ in _texts(window):
                n = len(text)
                clean |= n == len(low) == len(window)
                yield Layer(text, np.full(n, self.start, dtype=np.int64), np.full(n, self.end, dtype=np.int64))
            if not clean:
                yield Packed(window, self.start, self.end)


def secret_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each sorted by start, then kind.

    The worklist holds layers, and bytes, not yet unwrapped; it runs until none
    is left. A layer whose content and origin were met before is not taken up
    again, so wrappings that lead back to themselves end. All layers but
    inflated ones are shorter than what they came from; inflated bytes are read
    to their end in windows (WINDOW), and a token or stream that is longer than
    OVERLAP and lies over a window's edge is read in two parts.
    """
    base = scan(text)
    every = set(base)
    work: list[Layer | Packed] = [Layer(text)]
    seen = {_mark(text, 0, len(text))}
    while work:
        layer = work.pop()
        news = layer.layers() if isinstance(layer, Packed) else \
            (x for make in (_unwrap_url, _unwrap_unicode) if (x := make(layer)) is not None and x.text)
        for new in news if isinstance(layer, Packed) else itertools.chain(news, _unwrap_base64(layer)):
            if isinstance(new, Packed):
                mark = _mark(new.raw, new.start, new.end)
            else:
                mark = _mark(new.text, int(new.starts.min()), int(new.ends.max()))
            if mark in seen:
                continue
            seen.add(mark)
            if isinstance(new, Layer):
                every.update((*new.origin(a, b), kind) for a, b, kind in scan(new.text))
                if len(new.text) < MIN_RUN + 4:
                    continue  # too short to wrap anything
            work.append(new)
    in_order = lambda spans: sorted(spans, key=lambda x: (x[0], x[2], x[1]))
    return in_order(base), in_order(every)


def _mark(content: str | bytes, start: int, end: int) -> tuple:
    """A layer's content and origin; long contents by their digest."""
    if len(content) > 64:
        content = hashlib.blake2b(content if isinstance(content, bytes) else content.encode(), digest_size=32).digest()
    return content, start, end


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, the count of base spans of each kind, ``base_spans`` and
    ``spans`` ("kind:start:end", comma-joined; code points, end exclusive).

    A base span is the whole match. Null and empty text have none. Every row
    gives a row: null and repeated ids stay as they are. Other columns of
    ``docs`` are not read. Row by row; nothing is shuffled.
    """
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [secret_spans(t) for t in pdf["text"]]
            counts = [[sum(1 for s in base if s[2] == k) for base, _ in rows] for k in range(3)]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_assign": counts[0], "n_access": counts[1],
                "n_hex": counts[2], "base_spans": [_joined(b) for b, _ in rows],
                "spans": [_joined(a) for _, a in rows]})

    return id_out(docs.select(id_in(), text_or_empty().alias("text")).mapInPandas(
        batches, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"))
