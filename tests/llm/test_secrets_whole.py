"""Secrets in wrapped, shifted and embedded codes."""

import base64
import bz2
import gzip
import lzma
import random
import urllib.parse
import zlib

import pytest
import zstandard

from textquarry.llm import secrets

SECRET = b"password=SuperSecret123456"
R = random.Random(5)
FILLER = "".join(chr(R.randrange(97, 123)) + " " * (i % 7 == 6) for i in range(400)).encode()
b64 = lambda b: base64.b64encode(b).decode()
mime = lambda b: base64.encodebytes(b).decode()
hexed = lambda b, mark: "".join(f"{mark}{x:02x}" for x in b)

CODES = {
    "wrapped gzip": mime(gzip.compress(FILLER + b"\n" + SECRET)),
    "wrapped zlib, CRLF": mime(zlib.compress(FILLER + b"\n" + SECRET)).replace("\n", "\r\n"),
    "secret over a line end": mime(b"x" * 40 + b" " + SECRET + b" " + FILLER),
    "character over a line end": mime("é".encode() * 28 + b"y " + SECRET + "é".encode() * 99),
    "URL bytes in mid-line": "blob=" + hexed(gzip.compress(SECRET), "%"),
    "escaped bytes in mid-line": "blob=" + hexed(zlib.compress(SECRET), "\\x"),
    "after a slash": "path/" + b64(SECRET),
    "after a dash": "key-" + b64(gzip.compress(SECRET)),
    "after an underscore": "id_" + b64(SECRET),
    "second member": b64(gzip.compress(FILLER) + gzip.compress(SECRET)),
    "behind a header": b64(b"\x00\x01\x02" + lzma.compress(SECRET)),
    "second bz2": b64(bz2.compress(FILLER) + bz2.compress(SECRET)),
    "second zstd": b64(zstandard.compress(FILLER) + zstandard.compress(SECRET)),
}


@pytest.mark.parametrize("name", CODES)
def test_found(name):
    text = f"é vor {CODES[name]} nach"
    base, spans, _ = secrets.find(text)
    assert base == []
    assert [k for k, *_ in spans if k == 0], name
    assert all(6 <= a < b <= 6 + len(CODES[name]) for _, a, b in spans)


def test_split_between_members():
    code = b64(gzip.compress(SECRET[:12]) + gzip.compress(SECRET[12:]))
    assert [k for k, *_ in secrets.find(urllib.parse.quote(code))[1]] == [0]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
@pytest.mark.parametrize("before", [0, 3, 1 << 18])
def test_long_layers_are_read_in_windows(monkeypatch, pack, before):
    monkeypatch.setattr(secrets, "MAX_LAYER", 1 << 16)
    monkeypatch.setattr(secrets, "CARRY", 1 << 12)
    inner = b64(gzip.compress(SECRET)).encode()
    long = b" " * before + SECRET + b" " * ((1 << 16) - 30) + b" AKIA" + b"B" * 20 + b" " * (1 << 17) + b"0123456789abcdef0123 " + inner
    code = b64(pack(long) + gzip.compress(b"secret=" + b"m" * 20))
    base, spans, layers = secrets.find(f"x {code} y")
    assert base == [] and layers > 5
    assert {k for k, *_ in spans} == {0, 1, 2} and all(2 <= a < b <= 2 + len(code) for _, a, b in spans)
