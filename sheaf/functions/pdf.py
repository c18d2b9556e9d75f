"""Pages of PDF files without a PDF library: their number, and the text of simple fonts.

Follows the page tree over plain and compressed objects. Encrypted files are an error. Text is what the
content streams show, in Latin-1; glyphs of embedded fonts with codes of their own come out as those codes.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_SHOWN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>(?!>)|\b(?:Tj|TJ|T\*|Td|TD|ET|Tm)\b|['\"](?=\s)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"FlateDecode" in body[: found.start()]:
        return zlib.decompressobj().decompress(found[1])
    return found[1]


def _objects(raw: bytes) -> dict[int, bytes]:
    if re.search(rb"/Encrypt\b", raw):
        raise ValueError("the PDF is encrypted")
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            data = _inflated(body)
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
            heads = [int(x) for x in data[:first].split()[: 2 * n]]
            ends = [*heads[3::2], len(data) - first]
            for number, at, to in zip(heads[::2], heads[1::2], ends):
                found.setdefault(number, data[first + at : first + to])
    return found


def _value(body: bytes, key: bytes) -> bytes:
    m = re.search(rb"/" + key + rb"\s*(\[.*?\]|\d+\s+\d+\s+R\b)", body, re.S)
    return m[1] if m else b""


def _leaves(raw: bytes) -> tuple[dict[int, bytes], list[bytes]]:
    found, out, seen = _objects(raw), [], set()
    roots = [_value(b, b"Pages") for b in found.values() if re.search(rb"/Type\s*/Catalog\b", b)]
    todo = [int(n) for r in roots[-1:] for n in _REF.findall(r)]
    while todo:
        number = todo.pop(0)
        body = found.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if re.search(rb"/Type\s*/Pages\b", body):
            todo = [int(n) for n in _REF.findall(_value(body, b"Kids"))] + todo
        elif body:
            out.append(body)
    if not out:
        raise ValueError("the PDF has no page")
    return found, out


def page_count(raw: bytes) -> int:
    return len(_leaves(raw)[1])


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = b"".join(token[1:-1].split())
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        c = m[1]
        if c.isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c.endswith(b"\n") else _NAMED.get(c, c)

    return _ESCAPE.sub(plain, token[1:-1])


def page_texts(raw: bytes) -> list[str]:
    """What each page shows; a new line where the text position moves."""
    found, leaves = _leaves(raw)
    pages = []
    for body in leaves:
        data = b"\n".join(_inflated(found.get(int(n), b"")) for n in _REF.findall(_value(body, b"Contents")))
        lines, held = [b""], []
        for token in _SHOWN.findall(data):
            if token[:1] in b"(<":
                held.append(_string(token))
            elif token in (b"Tj", b"TJ"):
                lines[-1] += b"".join(held)
                held = []
            else:
                if lines[-1]:
                    lines.append(b"")
                lines[-1] += b"".join(held)
                held = []
        pages.append(b"\n".join(x for x in lines if x).decode("latin-1"))
    return pages
