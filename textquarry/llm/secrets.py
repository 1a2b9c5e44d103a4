"""Secret scan with a recursive decoding worklist.

A text is the first layer.  Every layer is scanned, and whatever it holds in URL
escapes, Unicode escapes, base64 or compressed form is unwrapped into further
layers, which go on the worklist until none is left.  A layer knows, for each of
its bytes, which bytes of the text it came from, so a find in any layer becomes a
span of the text.  A layer whose content and origin were seen before is not
unwrapped again, which ends cycles (an archive that contains itself).

The worklist is a stack of layers being unwrapped, so at any time there is one layer
for each depth.  A compressed layer that grows beyond MAX_LAYER is read as
a stream, in windows of which each begins with the last CARRY bytes of the one before.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Generator, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # the maximal runs that are long enough
#: Lower-case pieces of which every assignment holds one.
HINTS = (b"passw", b"secret", b"token", b"api")

URL_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
UNICODE_ESCAPE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: The shortest secret, 16 characters, takes 22 in base64.
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{22,}={0,2}")
#: Lines of base64, joined over the line ends.
WRAPPED = re.compile(rb"[A-Za-z0-9+/_-]{22,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(rb"[A-Za-z0-9+/_=-]+")
#: The text in what is decoded at another phase; the shortest secret has 16 characters.
PIECE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
#: Where compressed data may begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: A compressed layer that grows beyond this is read in windows; only there may a code inside it that is longer than CARRY be torn apart.
MAX_LAYER, CARRY = 16 << 20, 1 << 20


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, leftmost and non-overlapping for each kind."""
    found = []
    lower = data.lower()
    if any(h in lower for h in HINTS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(data)]
    return found


BROKEN = (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError)


def _stream(data: memoryview, size: int) -> Generator[bytes, None, tuple[bool, bytes]]:
    """What the stream at the beginning of data unpacks to, in pieces of about `size` at most;
    returns whether it is known to be whole, and the bytes after it.  Raises one of BROKEN."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 6 and int.from_bytes(data[:2]) % 31 == 0:
        z = zlib.decompressobj(31 if data[:1] == b"\x1f" else 15)
        rest: bytes | memoryview = data
        while True:
            out = z.decompress(rest, size)
            if out:
                yield out
            if z.eof:
                return True, z.unused_data
            rest = z.unconsumed_tail
            if not out and not rest:
                return False, b""
    if data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\0":
        d = bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()
        yield d.decompress(data, size)
        while not d.eof and not d.needs_input:
            yield d.decompress(b"", size)
        return True, d.unused_data if d.eof else b""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        x = zstandard.ZstdDecompressor().decompressobj()
        for at in range(0, len(data), 1024):  # a piece cannot grow beyond some MB
            yield x.decompress(data[at : at + 1024])
            if x.eof:
                return True, x.unused_data + bytes(data[at + 1024 :])
        return True, b""
    raise ValueError("no stream")


def _member(data: memoryview) -> tuple[bytes | None, bytes] | None:
    """What the stream at the beginning of data unpacks to (None: more than MAX_LAYER), and the bytes after it."""
    out, size, stream = [], 0, _stream(data, MAX_LAYER + 1)
    try:
        while True:
            piece = next(stream)
            size += len(piece)
            if size <= MAX_LAYER:
                out.append(piece)
    except StopIteration as end:
        whole, rest = end.value
    except BROKEN:
        whole, rest = False, b""
    if size > MAX_LAYER:
        return None, rest
    return (b"".join(out), rest) if whole else None


def _windows(data: memoryview) -> Iterator[bytes]:
    """A long stream in windows; what precedes a fault in it counts."""
    held: list[bytes] = []
    size = 0
    try:
        for piece in _stream(data, MAX_LAYER):
            held.append(piece)
            size += len(piece)
            if size > MAX_LAYER:
                window = b"".join(held)
                yield window
                held, size = [window[-CARRY:]], 0
    except BROKEN:
        pass
    yield b"".join(held)


def _decompress(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """What compressed streams at any place unpack to, streams in a row as one; where they begin and end."""
    view, at = memoryview(data), 0
    while m := MAGIC.search(data, at):
        begin = at = m.start()
        out = b""
        while (member := _member(view[at:])) is not None:
            end = len(data) - len(member[1])
            if member[0] is None or len(out) + len(member[0]) > MAX_LAYER:
                yield out, begin, at
                out, begin = b"", at
            if member[0] is None:
                for window in _windows(view[at:]):
                    yield window, at, end
                begin = end
            else:
                out += member[0]
            at = end
        if out:
            yield out, begin, at
        at = max(at, m.start() + 1)


def _is_text(data: bytes) -> bool:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return not any(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)


class _Layer:
    """Bytes, and the part of the text each came from: lists, or one span for all."""

    def __init__(self, data: bytes, start: list[int] | range | int, end: list[int] | range | int):
        self.data, self.start, self.end = data, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.start, int):
            return self.start, self.end
        return self.start[a], self.end[b - 1]


def _unescape(layer: _Layer, escape: re.Pattern, value) -> Iterator[_Layer]:
    """Each line that holds escapes, with all of them replaced.  No find spans lines."""
    data, done = layer.data, 0
    for first in escape.finditer(data):
        if first.start() < done:
            continue
        a = data.rfind(b"\n", 0, first.start()) + 1
        b = data.find(b"\n", first.end())
        b = done = len(data) if b < 0 else b
        out, start, end, at, fixed = bytearray(), [], [], a, isinstance(layer.start, int)
        for m in escape.finditer(data, a, b):
            new = value(m)
            out += data[at : m.start()] + new
            if not fixed:
                start += layer.start[at : m.start()]
                end += layer.end[at : m.start()]
                s, e = layer.span(*m.span())
                start += [s] * len(new)
                end += [e] * len(new)
            at = m.end()
        out += data[at:b]
        if fixed:
            yield _Layer(bytes(out), layer.start, layer.end)
        else:
            yield _Layer(bytes(out), start + list(layer.start[at:b]), end + list(layer.end[at:b]))


def _url(m: re.Match) -> bytes:
    return bytes([int(m[1], 16)])


def _unicode(m: re.Match) -> bytes:
    code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
    return chr(code).encode(errors="surrogatepass") if code < 0x110000 else m[0]


def _raw(m: re.Match) -> bytes:
    return bytes([int(m[3], 16)]) if m[3] else _unicode(m)


def _decode(run: bytes) -> bytes | None:
    run = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(run) % 4 == 1:
        run = run[:-1]
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4))
    except binascii.Error:
        return None


def _base64(run: bytes, span) -> Iterator[_Layer]:
    """A run as a whole if it is text; otherwise the text and the compressed streams in it at each phase,
    since '/', '-', '_' and letters before the code look as if they belonged to it.  span: of a part of the run."""
    for phase in range(4):
        out = _decode(run[phase:])
        if not out:
            continue
        if phase == 0 and _is_text(out):
            yield _Layer(out, *span(0, len(run)))
            return
        place = lambda a, b, phase=phase: span(phase + a // 3 * 4, min(len(run), phase + -(-b // 3) * 4))
        for m in PIECE.finditer(out):
            yield _Layer(m[0], *place(*m.span()))
        for data, a, b in _decompress(out):
            yield _Layer(data, *place(a, b))


def unwrap(layer: _Layer) -> Iterator[_Layer]:
    data = layer.data
    for out, a, b in _decompress(data):
        yield _Layer(out, *layer.span(a, b))
    if b"%" in data:
        yield from _unescape(layer, URL_ESCAPE, _url)
    if b"\\" in data or b"&#" in data:
        yield from _unescape(layer, UNICODE_ESCAPE, _unicode)
        if b"\\x" in data:  # bytes of a stream or of UTF-8, not code points
            yield from _unescape(layer, UNICODE_ESCAPE, _raw)
    for m in BASE64.finditer(data):
        yield from _base64(m[0], lambda a, b, at=m.start(): layer.span(at + a, at + b))
    for m in WRAPPED.finditer(data):
        places = [i for x in LINE.finditer(data, *m.span()) for i in range(*x.span())]
        yield from _base64(bytes(data[i] for i in places), lambda a, b, p=places: layer.span(p[a], p[b - 1] + 1))


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans, and the number of layers; spans in code points of the text."""
    data = (text or "").encode(errors="surrogatepass")
    base = scan(data)
    spans, seen, layers = set(base), set(), 0
    work = [iter([_Layer(data, range(len(data)), range(1, len(data) + 1))] if data else [])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.data:
            continue
        key = (hashlib.sha256(layer.data).digest(), layer.span(0, len(layer.data)))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        if layers > 1:
            for kind, a, b in scan(layer.data):
                spans.add((kind, *layer.span(a, b)))
        work.append(unwrap(layer))
    if spans and len(data) != len(text):
        place, at, n = {}, 0, 0
        for x in sorted({x for s in spans for x in s[1:]}):
            n += len(data[at:x].decode(errors="surrogatepass"))
            place[x], at = n, x
        base = [(k, place[a], place[b]) for k, a, b in base]
        spans = {(k, place[a], place[b]) for k, a, b in spans}
    order = lambda s: (s[1], s[0], s[2])
    return sorted(base, key=order), sorted(spans, key=order), max(layers, 1)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = [find(t if isinstance(t, str) else None) for t in rows.text]
        frame = pd.DataFrame({"doc_id": rows.doc_id.astype("Int64")})
        for k, kind in enumerate(KINDS):
            frame[f"n_{kind}"] = [sum(s[0] == k for s in base) for base, _, _ in out]
        frame["base_spans"] = [_joined(base) for base, _, _ in out]
        frame["spans"] = [_joined(spans) for _, spans, _ in out]
        frame["n_layers"] = [n for _, _, n in out]
        yield frame


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_spans,
    spans, n_layers.

    The counts and base_spans are of the plain text; spans adds what decoding
    brings to light, at the place of the encoded characters.  Null text counts as
    empty; repeated rows are reported each time; a null doc_id stays null; other
    columns are ignored.  No text is cut.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scan_rows, schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_layers")


QUERIES = {"op3_secrets": op3_secrets}
