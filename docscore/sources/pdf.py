"""The text layer of PDF files, and plain PDF files of text lines.

Reading covers what text layers need: cross-referenced and packed objects, deflated
streams, the page tree, simple and composite fonts with a Unicode map, and the
operators that place and show text. Encrypted files and other filters give no text;
rendering pages as images is left to external tools.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = b" \t\r\n\x0c\0"
DELIMITER = b"()<>[]{}/%"
TOKEN = re.compile(rb"[^ \t\r\n\x0c\0()<>\[\]{}/%]+")
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
# a step back of more than this share of the font size, in a thousandth of it, is a space
GAP = 200
ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    pass


class Word(bytes):
    """An operator or keyword."""


class Parser:
    """Values of the PDF syntax from a place in the data on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            if data[self.at] in SPACE:
                self.at += 1
            elif data[self.at] == 0x25:  # a comment
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self):
        """The next value; ``None`` at the end or before a closing bracket."""
        self.skip()
        data = self.data
        if self.at >= len(data):
            return None
        c = data[self.at : self.at + 1]
        if c == b"/":
            self.at += 1
            found = TOKEN.match(data, self.at)
            raw = found[0] if found else b""
            self.at += len(raw)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))
        if data[self.at : self.at + 2] == b"<<":
            self.at += 2
            return self._pairs()
        if c == b"<":
            end = data.find(b">", self.at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self._string()
        if c == b"[":
            self.at += 1
            out = []
            while (item := self.value()) is not None:
                out.append(item)
            self.skip()
            self.at += data[self.at : self.at + 1] == b"]"
            return _with_refs(out)
        if c in b"])>}{":
            if c in b"{}":
                self.at += 1
                return Word(c)
            return None
        found = TOKEN.match(data, self.at)
        self.at = found.end()
        return _number(found[0])

    def _pairs(self) -> dict:
        items = []
        while (item := self.value()) is not None:
            items.append(item)
        self.skip()
        self.at += 2 * (self.data[self.at : self.at + 2] == b">>")
        items = _with_refs(items)
        return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}

    def _string(self) -> bytes:
        data, out, depth = self.data, bytearray(), 1
        self.at += 1
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(data):
                c = data[self.at]
                octal = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                self.at += 1
                if c == 0x0D and data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                if c not in b"\r\n":
                    out += ESCAPES.get(c, bytes([c]))
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return bytes(out)


def _number(raw: bytes):
    try:
        return int(raw)
    except ValueError:
        pass
    try:
        return float(raw) if raw[:1] in b"+-.0123456789" else Word(raw)
    except ValueError:
        return Word(raw)


def _with_refs(items: list) -> list:
    out: list = []
    for item in items:
        if item == b"R" and isinstance(item, Word) and len(out) >= 2 and isinstance(out[-1], int) and isinstance(out[-2], int):
            out[-2:] = [Ref(out[-2])]
        else:
            out.append(item)
    return out


class File:
    """The objects of a PDF file, later ones taking the place of earlier ones of the same number."""

    def __init__(self, data: bytes):
        self.data = data
        self.at = {int(m[1]): m.end() for m in OBJECT.finditer(data)}
        self.packed: dict[int, object] = {}
        for number in list(self.at):
            value = self.get(Ref(number))
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value, self.stream(number))

    def _unpack(self, spec: dict, body: bytes) -> None:
        count, first = self.get(spec.get("N")), self.get(spec.get("First"))
        if not isinstance(count, int) or not isinstance(first, int):
            return
        parser = Parser(body)
        pairs = [(parser.value(), parser.value()) for _ in range(count)]
        for number, place in pairs:
            if isinstance(number, int) and isinstance(place, int) and number not in self.at:
                self.packed[number] = Parser(body, first + place).value()

    def get(self, value):
        """The value, or what a reference stands for."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            if value.number in self.at:
                value = Parser(self.data, self.at[value.number]).value()
            else:
                value = self.packed.get(value.number)
        return None

    def stream(self, number: int) -> bytes:
        """The bytes of a stream object, decoded; empty where a filter is not supported."""
        parser = Parser(self.data, self.at.get(number, len(self.data)))
        spec = parser.value()
        parser.skip()
        if not isinstance(spec, dict) or self.data[parser.at : parser.at + 6] != b"stream":
            return b""
        start = parser.at + 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1
        size = self.get(spec.get("Length"))
        if not isinstance(size, int) or self.data[start + size : start + size + 20].lstrip()[:9] != b"endstream":
            size = max(self.data.find(b"endstream", start) - start, 0)
        body = self.data[start : start + size]
        filters = self.get(spec.get("Filter"))
        for name in [filters] if isinstance(filters, Name) else filters or []:
            if self.get(name) not in ("FlateDecode", "Fl"):
                return b""
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                return b""
        return body

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with the resources they inherit."""
        roots = [v for n in [*self.at, *self.packed] if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "Catalog"]
        todo = [(roots[-1].get("Pages"), {})] if roots else []
        seen = set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            seen.add(ref)
            node = {k: above[k] for k in ("Resources",) if k in above} | node
            if node.get("Type") == "Page" or "Kids" not in node:
                yield node
            else:
                todo += [(kid, node) for kid in reversed(self.get(node["Kids"]) or [])]

    def contents(self, page: dict) -> bytes:
        parts = page.get("Contents")
        if isinstance(parts, Ref) and isinstance(found := self.get(parts), list):
            parts = found
        parts = parts if isinstance(parts, list) else [parts]
        return b"\n".join(self.stream(p.number) for p in parts if isinstance(p, Ref))

    def fonts(self, page: dict) -> dict[str, Font]:
        resources = self.get(page.get("Resources")) or {}
        found = self.get(resources.get("Font")) or {}
        return {name: Font(self, self.get(ref) or {}) for name, ref in found.items()}


class Font:
    """How the codes of a font become text."""

    def __init__(self, file: File, spec: dict):
        self.wide = spec.get("Subtype") == "Type0"
        self.table: dict[int, str] = {}
        encoding = file.get(spec.get("Encoding"))
        code = 0
        for item in (file.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            if isinstance(item, int):
                code = item
            elif isinstance(item, Name):
                if found := re.fullmatch(r"uni([0-9A-Fa-f]{4})|([A-Za-z])", item):
                    self.table[code] = chr(int(found[1], 16)) if found[1] else found[2]
                code += 1
        if isinstance(ref := spec.get("ToUnicode"), Ref):
            self._read_map(file.stream(ref.number))

    def _read_map(self, body: bytes) -> None:
        text = lambda raw: raw.decode("utf-16-be", "replace")
        number = lambda raw: int.from_bytes(raw, "big")
        parser, items = Parser(body), []
        while parser.at < len(body):
            item = parser.value()
            if item is None:
                parser.at += 1
            elif isinstance(item, Word):
                if item == b"endbfchar":
                    self.table |= {number(a): text(b) for a, b in zip(items[::2], items[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
                elif item == b"endbfrange":
                    for a, b, to in zip(items[::3], items[1::3], items[2::3]):
                        for k in range(min(number(b) - number(a) + 1, 1 << 16)):
                            self.table[number(a) + k] = text(to[k]) if isinstance(to, list) and k < len(to) else text((number(to) + k).to_bytes(len(to), "big")) if isinstance(to, bytes) else ""
                items = []
            else:
                items.append(item)

    def text(self, raw: bytes) -> str:
        if self.wide:
            return "".join(self.table.get(int.from_bytes(raw[k : k + 2], "big"), "") for k in range(0, len(raw), 2))
        plain = lambda c: self.table.get(c) or bytes([c]).decode("cp1252", "replace")
        return "".join(map(plain, raw))


def page_text(body: bytes, fonts: dict[str, Font]) -> str:
    """Shown strings of a page; a new line where the baseline moves, a space where the pen moves along it."""
    parser, items, out = Parser(body), [], []
    font, moved, height = Font(File(b""), {}), False, 0.0

    def show(raw) -> None:
        if isinstance(raw, bytes):
            out.append(font.text(raw))

    def move(x: float, y: float) -> None:
        out.append("\n" if abs(y) > 0.01 else " " if x else "")

    while parser.at < len(body):
        item = parser.value()
        if item is None:
            parser.at += 1
            continue
        if not isinstance(item, Word):
            items.append(item)
            continue
        numbers = [x for x in items if isinstance(x, (int, float))]
        if item == b"BI":  # an image inside the page
            end = re.compile(rb"\sEI\b").search(body, parser.at)
            parser.at = end.end() if end else len(body)
        elif item == b"Tf" and items and isinstance(items[0], str):
            font = fonts.get(items[0], font)
        elif item == b"BT":
            moved, height = False, height
        elif item in (b"Td", b"TD") and len(numbers) >= 2:
            move(numbers[-2], numbers[-1])
            height += numbers[-1]
        elif item == b"Tm" and len(numbers) >= 6:
            move(1.0 if moved else 0.0, numbers[-1] - height)
            height, moved = numbers[-1], True
        elif item == b"T*":
            out.append("\n")
        elif item == b"Tj" and items:
            show(items[-1])
        elif item in (b"'", b'"') and items:
            out.append("\n")
            show(items[-1])
        elif item == b"TJ" and items and isinstance(items[-1], list):
            for x in items[-1]:
                if isinstance(x, (int, float)):
                    out.append(" " if x < -GAP else "")
                else:
                    show(x)
        items = []
    lines = (re.sub(" +", " ", line).strip(" ") for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def text_layer(data: bytes) -> str | None:
    """The text of all pages, pages joined by newlines; null for what is no readable PDF."""
    if b"%PDF-" not in data[:1024] or re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        return None
    try:
        file = File(data)
        return "\n".join(page_text(file.contents(p), file.fonts(p)) for p in file.pages())
    except (ValueError, IndexError, TypeError, AttributeError, RecursionError, OverflowError):
        return None


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of the PDF files below a folder; text is null for files that cannot be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text_layer(part.column(1)[0].as_py() or b"")], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def text_pdf(lines: list[str], per_page: int = 60, size: int = 9) -> bytes:
    """A PDF of text lines in a fixed-width font, ``per_page`` to a page; letters beyond Windows-1252 become question marks."""
    pages = [lines[k : k + per_page] for k in range(0, len(lines), per_page)] or [[]]
    escape = lambda s: re.sub(rb"([()\\])", rb"\\\1", s.encode("cp1252", "replace"))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        body = b"BT /F1 %d Tf %d TL 40 800 Td\n" % (size, size + 4) + b"".join(b"(%b) Tj T*\n" % escape(line) for line in page) + b"ET"
        packed = zlib.compress(body)
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(packed), packed))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 842 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%b] >>" % (len(kids), b" ".join(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)
