"""Text of PDF files by page: what simple files hold as text, without rendering, layout or character recognition.

A file is read as its objects (also those in object streams); the page tree gives the pages in order. A page's content is
run as far as text goes: strings that are shown are decoded by their font's map to Unicode, or else as Windows Latin; moves
to another line are line breaks, wide gaps inside a line are blanks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)(?:\r?\n)?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[-+.\d]+|[A-Za-z*'\"]+|%[^\r\n]*", re.DOTALL)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A move inside a line, in thousandths of the font's size, that stands for a blank.
GAP = 180


class PdfFile:
    def __init__(self, content: bytes) -> None:
        if not content.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise ValueError("an encrypted PDF")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self.objects |= dict(self._packed(body))

    def _packed(self, body: bytes) -> Iterator[tuple[int, bytes]]:
        data, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = [int(x) for x in data[:first].split()]
        starts = numbers[1::2]
        for name, start, end in zip(numbers[::2], starts, [*starts[1:], len(data) - first], strict=False):
            yield name, data[first + start : first + end]

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" not in body[: m.start()]:
            return m[1]
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error as e:
            raise ValueError(f"a damaged stream: {e}") from None

    def _value(self, body: bytes, key: bytes) -> bytes:
        """What stands behind a key: the object that is referred to, or the dictionary or array itself."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if r := _REFERENCE.match(rest):
            return self.objects.get(int(r[1]), b"")
        opening, closing = (b"<<", b">>") if rest.startswith(b"<<") else (b"[", b"]")
        depth = 0
        for t in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
            depth += 1 if t[0] == opening else -1
            if not depth:
                return rest[: t.end()]
        return rest

    def pages(self) -> list[bytes]:
        """Bodies of the pages in order, with what they inherit behind."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[bytes] = []

        def walk(body: bytes, inherited: bytes, seen: frozenset[bytes]) -> None:
            if re.search(rb"/Type\s*/Pages", body):
                for r in _REFERENCE.finditer(self._value(body, b"Kids")):
                    if r[1] not in seen:
                        walk(self.objects.get(int(r[1]), b""), body + inherited, seen | {r[1]})
            elif body:
                out.append(body + b"\n" + inherited)

        walk(self._value(root, b"Pages"), b"", frozenset())
        return out

    def _fonts(self, page: bytes) -> dict[bytes, dict[int, str] | None]:
        """For each font's name its map from codes to text, and under -1 the width of a code; None: Windows Latin."""
        fonts = self._value(self._value(page, b"Resources"), b"Font")
        out = {}
        for m in re.finditer(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts):
            chart = self.stream(self._value(self.objects.get(int(m[2]), b""), b"ToUnicode"))
            out[m[1]] = _chart(chart) if chart else None
        return out

    def text(self, page: bytes) -> str:
        contents = self._value(page, b"Contents")
        parts = [contents] if _STREAM.search(contents) else [self.objects.get(int(r[1]), b"") for r in _REFERENCE.finditer(contents)]
        fonts, font = self._fonts(page), None
        out, held = [], []
        for token in _TOKEN.findall(b"\n".join(map(self.stream, parts))):
            if token[:1] in b"(<[]/-+.0123456789%":
                held.append(token)
                continue
            if token == b"Tf" and len(held) > 1:
                font = fonts.get(held[-2][1:])
            elif token in (b"Td", b"TD") and len(held) > 1:
                out.append("\n" if float(held[-1]) else " ")
            elif token in (b"T*", b"ET", b"Tm"):
                out.append("\n")
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                out += ["\n"] * (token in (b"'", b'"'))
                for x in held:
                    if x[:1] in b"(<":
                        out.append(_decoded(x, font))
                    elif token == b"TJ" and x[:1] in b"-." and float(x) < -GAP:
                        out.append(" ")
            held = []
        return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def _raw(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: _ESCAPES.get(m[1], b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1])


def _decoded(token: bytes, chart: dict[int, str] | None) -> str:
    raw = _raw(token)
    if chart is None:
        return raw.decode("cp1252", "replace")
    width = int(chart[-1])
    return "".join(chart.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _chart(cmap: bytes) -> dict[int, str]:
    """Codes to text from a map to Unicode."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    width = 1
    for kind, block in re.findall(rb"begin(bfchar|bfrange|codespacerange)(.*?)end", cmap, re.DOTALL):
        if kind == b"codespacerange":
            width = max((len(h) // 2 for h in re.findall(rb"<([0-9A-Fa-f]+)>", block)), default=1)
        elif kind == b"bfchar":
            out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
        else:
            for a, b, first, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.DOTALL):
                codes = range(int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF) + 1)
                if first:
                    start = text(first)
                    out |= {c: start[:-1] + chr(ord(start[-1]) + k) for k, c in enumerate(codes)}
                else:
                    out |= dict(zip(codes, map(text, re.findall(rb"<([0-9A-Fa-f]+)>", each)), strict=False))
    return out | {-1: str(width)}


class PdfTextExtractor:
    """Texts of a PDF's pages."""

    name = "pdf_text"

    def extract(self, path: str, content: bytes) -> list[str]:
        file = PdfFile(content)
        return [file.text(page) for page in file.pages()]
