"""Pages of PDF files as text, by the standard library alone: text-showing operators of the pages' content streams.

Lines end where the text's position moves to another line. Strings count as Windows-1252, or as UTF-16 with a byte-order
mark; fonts with encodings of their own need a layout tool, which takes this module's place by files.pdf_branch().
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+|/[^\s/\[\]()<>]+|<<|>>", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _content(body: bytes) -> bytes:
    """An object's stream, unpacked where it is packed in a way known here."""
    found = _STREAM.search(body)
    if found is None:
        return b""
    head, data = body[: found.start()], found[1]
    if b"/FlateDecode" not in head:
        return b"" if b"/Filter" in head else data
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return b""


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            inside = _content(body)
            count, first = (int(x[1]) if (x := re.search(rb"/%s\s+(\d+)" % name, body)) else 0 for name in (b"N", b"First"))
            places = [int(x) for x in inside[:first].split()[: 2 * count]]
            for k in range(0, len(places) - 1, 2):
                end = places[k + 3] if k + 3 < len(places) else len(inside) - first
                found.setdefault(places[k], inside[first + places[k + 1] : first + end])
    return found


def _page_order(objects: dict[int, bytes]) -> list[bytes]:
    """Pages as the tree has them; in order of their numbers where there is no tree."""
    is_page = lambda body: re.search(rb"/Type\s*/Page\b(?!s)", body)
    roots = [int(m[1]) for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body) and (m := re.search(rb"/Pages\s+(\d+)", body))]
    out: list[bytes] = []
    todo, seen = roots[:1], set()
    while todo:
        number = todo.pop(0)
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if is_page(body):
            out.append(body)
        elif kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            todo = [int(m[1]) for m in _REF.finditer(kids[1])] + todo
    return out or [objects[k] for k in sorted(objects) if is_page(objects[k])]


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: _PLAIN.get(m[1]) or (b"" if m[1].endswith(b"\n") else m[1] if not m[1].isdigit() else bytes([int(m[1], 8) & 255])), token[1:-1])
    return raw.decode("utf-16") if raw.startswith((b"\xfe\xff", b"\xff\xfe")) else raw.decode("cp1252", "replace")


def _text(content: bytes) -> str:
    out: list[str] = []
    held: list = []
    height = None
    for match in _TOKEN.finditer(content):
        token = match[0]
        if token[:1] in b"(<" and token not in (b"<<", b">>"):
            held.append(_string(token))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            held.append(float(token))
        elif token in (b"[", b"]"):
            continue
        else:
            if token in (b"'", b'"', b"T*"):
                out.append("\n")
            if token in (b"Td", b"TD") and len(held) > 1 and held[-1]:
                out.append("\n")
            if token == b"Tm" and len(held) > 5:
                out.append("\n" if height not in (None, held[-1]) else " ")
                height = held[-1]
            if token in (b"Tj", b"'", b'"'):
                out += [x for x in held if isinstance(x, str)][-1:]
            if token == b"TJ":
                # a wide gap to the left of a string is a blank
                out += [x if isinstance(x, str) else " " if x < -200 else "" for x in held]
            if token == b"ET":
                out.append("\n")
            held = []
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def pages(data: bytes) -> list[str]:
    """The text of each page, in order; a file that isn't a PDF fails."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("not a PDF file")
    objects = _objects(data)
    out = []
    for body in _page_order(objects):
        held = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        parts = [_content(objects.get(int(m[1]), b"")) for m in _REF.finditer(held[1])] if held else []
        out.append(_text(b"\n".join(parts)))
    return out
