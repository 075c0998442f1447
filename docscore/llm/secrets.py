"""Secret scan: pattern candidates, and encodings confirmed by their structure.

The base patterns report what looks like a credential. A second group of candidates
is decoded from base64 (over several lines too) or hex and reported only if the bytes parse: DER sequences
whose nested lengths fill their parents exactly, length-prefixed key records, and
signed tokens whose header is a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: base patterns and their shortest findings
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

# a lookahead, so that a refused candidate does not hide one that begins inside it
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[^-]|-(?!----))+)-----END \1-----")
ESCAPED = re.compile(r"\\+([nrt/])")
HEADERS = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+\S[^\n]*\n)*)+")
ENCRYPTED = re.compile(r"Proc-Type:[ \t]*4,[ \t]*ENCRYPTED\s.*?DEK-Info:[ \t]*[A-Z0-9-]+,[ \t]*((?:[0-9A-Fa-f]{16}){1,2})\s", re.DOTALL)
# base64 wrapped over lines, also as a string with escaped line ends
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}(?:(?:[ \t\r]*\n[ \t]*|(?:\\r)?\\n)[A-Za-z0-9+/]{40,})*(?:[ \t\r]*\n[ \t]*|(?:\\r)?\\n)[A-Za-z0-9+/]+={0,2}")
LINE = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/\\]))[A-Za-z0-9+/]+={0,2}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")
OPENSSH = b"openssh-key-v1\x00"
KINDS = ("assign", "access", "hex", "token", "armor", "base64_key", "hex_key")


def _unbase64(text: str, url: bool = False) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except binascii.Error:
        return None


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """``(tag, start, end)`` of the contents of the DER value at ``at``; lengths in their shortest form only."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F:
        return None
    if size & 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or start + count > end:
            return None
        size = int.from_bytes(data[start : start + count], "big")
        if size < 0x80 or data[start] == 0:
            return None
        start += count
    return (tag, start, start + size) if start + size <= end else None


def _der_fills(data: bytes, at: int, end: int) -> bool:
    """Do well-formed values, nested ones too, fill ``at`` to ``end`` exactly? At any depth."""
    ends = [end]
    while ends:
        if at == ends[-1]:
            ends.pop()
            continue
        item = _der_item(data, at, ends[-1])
        if item is None:
            return False
        tag, start, stop = item
        if tag == 0x02 and start == stop:  # an integer has contents
            return False
        if tag & 0x20:
            ends.append(stop)
            at = start
        else:
            at = stop
    return True


def is_der_key(data: bytes) -> bool:
    """A DER sequence of at least two values, all lengths consistent, with an integer, bit string or octet string of key size."""
    top = _der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or not _der_fills(data, top[1], top[2]):
        return False
    parts, at = [], top[1]
    while at < top[2]:
        tag, start, at = _der_item(data, at, top[2])
        parts.append((tag, at - start))
    return len(parts) >= 2 and any(tag in (0x02, 0x03, 0x04) and size >= 20 for tag, size in parts)


def _record(data: bytes, at: int) -> tuple[bytes, int] | None:
    size = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or at + 4 + size > len(data):
        return None
    return data[at + 4 : at + 4 + size], at + 4 + size


def is_record_key(data: bytes) -> bool:
    """Length-prefixed records that fill it exactly: an OpenSSH private key file, or a public key."""
    if data.startswith(OPENSSH):
        at = len(OPENSSH)
        for _ in range(3):  # cipher, key derivation and its options
            found = _record(data, at)
            if found is None:
                return False
            at = found[1]
        count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        # each key's public part, then one part with all private ones
        for _ in range(count + 1):
            found = _record(data, at)
            if found is None:
                return False
            at = found[1]
        return count >= 1 and at == len(data)
    found = _record(data, 0)
    if found is None or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", found[0]):
        return False
    at, count = found[1], 0
    while at < len(data):
        found = _record(data, at)
        if found is None:
            return False
        at, count = found[1], count + 1
    return count >= 1


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_record_key(data))


def is_armored_key(body: str) -> bool:
    """The body of a PEM block, escaped line ends and header lines allowed, decodes to a key.

    An encrypted body has no structure but its headers: a cipher with an initial
    vector, and whole cipher blocks of that size.
    """
    if "\\" in body:
        body = ESCAPED.sub(lambda m: {"n": "\n", "r": "\r", "t": "\t", "/": "/"}[m[1]], body)
    headers = HEADERS.match(body)
    data = _unbase64(body[headers.end() :] if headers else body)
    sealed = ENCRYPTED.search(headers[0]) if headers else None
    if sealed and data:
        return len(data) >= 32 and len(data) % (len(sealed[1]) // 2) == 0
    return is_key(data)


def wrapped_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of keys over two or more of the base64 lines between ``start`` and ``end``.

    The length at the head of a DER key says where it ends; records are tried to the last line and the one before.
    """
    lines = [m.span() for m in LINE.finditer(text, start, end)]
    first = 0
    while first < len(lines):
        a, b = lines[first]
        head = _unbase64(text[a : min(b, a + 40)])
        lasts: list[int] = []
        if head and head[:1] == b"\x30" and (b - a) >= 40:
            size = head[1] if head[1] < 0x80 else int.from_bytes(head[2 : 2 + (head[1] & 0x7F)], "big")
            chars = -(-(size + 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)) * 4 // 3)
            got, last = 0, first
            while last < len(lines) and got < chars:
                got += len(text[slice(*lines[last])].rstrip("="))
                last += 1
            if got == chars:
                lasts = [last - 1]
        elif head and (OPENSSH.startswith(head[:15]) or head[:3] == b"\0\0\0"):
            lasts = [len(lines) - 1, len(lines) - 2]
        for last in lasts:
            if last > first and is_key(_unbase64("".join(text[slice(*x)] for x in lines[first : last + 1]))):
                yield a, lines[last][1]
                first = last
                break
        first += 1


def is_signed_token(header: str, body: str) -> bool:
    """The header decodes to a JSON object with an algorithm; the body decodes too."""
    if not header.startswith(("ey", "ew")) or _unbase64(body, True) is None:
        return False
    try:
        head = json.loads(_unbase64(header, True) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose decoded bytes have the structure of a key or a signed token."""
    found = []
    if "." in text and ("ey" in text or "ew" in text):
        found += [(m.start(), m.end(3), "token") for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        for m in ARMOR.finditer(text):
            if is_armored_key(m[2]):
                found.append((m.start(), m.end(), "armor"))
    armored = [(a, b) for a, b, kind in found if kind == "armor"]
    lines = list(BASE64.finditer(text))
    found += [(m.start(), m.end(), "base64_key") for m in lines if is_key(_unbase64(m[0]))]
    if lines:
        for m in WRAPPED.finditer(text):
            if not any(a <= m.start() < b for a, b in armored):
                found += [(a, b, "base64_key") for a, b in wrapped_keys(text, m.start(), m.end())]
    found += [(m.start(), m.end(), "hex_key") for m in ANY_HEX.finditer(text) if is_key(bytes.fromhex(m[0]))]
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed`` for each input row.

    Spans are ``kind:start:end`` in code points, ends exclusive, by start and then
    kind. Null and empty texts have none: zero counts and the digest of the empty
    string. Repeated rows stay repeated; an empty table gives no rows; other columns
    are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base, more = base_spans(text), confirmed_spans(text)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, _joined(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], names)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
