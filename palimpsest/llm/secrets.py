"""Finding credentials in texts and confirming candidates by their structure.

Three base patterns find assignments, access key names and hex strings. Beside them, base64
and hex candidates are decoded, and reported only if what they hold parses: a key in DER
with nested lengths that add up, an OpenSSH private key with its length-prefixed fields, or
a signed token whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: In the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "openssh_key", "signed_token")

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Of a key's armour; lines may end in an escaped newline; header lines, with the cipher and its
#: start value, come before the body. No part can reach beyond the next run of five hyphens.
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_HEADER = re.compile(r"(?:\s|\\[nr])++[A-Za-z-]++: (?:[^\n\\-]|-(?!----))*+(?=[\n\\])")
_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[nr])++")
_CIPHER = re.compile(r"DEK-Info: ([A-Z0-9-]+),((?:[0-9A-Fa-f]{16}){1,2})\s*$", re.MULTILINE)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_BLOB = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){24,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){24,}(?![0-9A-Za-z])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_OPENSSH = b"openssh-key-v1\0"


def _der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly, or None."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or data[at] == 0:
                return None
            at += n
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


#: Constructed values within constructed values that are followed.
MOST_DEPTH = 16
_INTEGER, _OCTETS, _NAME, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _nested(data: bytes, at: int, end: int, depth: int = MOST_DEPTH) -> list[tuple[int, int, int]] | None:
    """The values of data[at:end], if they and all that constructed ones hold add up; else None."""
    items = _der_items(data, at, end)
    if items is None or not depth:
        return None
    for tag, a, b in items:
        if tag & 0x20 and _nested(data, a, b, depth - 1) is None:
            return None
    return items


def _is_positive(data: bytes, at: int, end: int) -> bool:
    """A DER integer above 0 without a needless leading byte."""
    if at == end or data[at] & 0x80 or end - at == 1 and not data[at]:
        return False
    return not (data[at] == 0 and end - at > 1 and data[at + 1] < 0x80)


def is_der_key(data: bytes, depth: int = 2) -> bool:
    """A private key in DER: a sequence that starts with a version and, nested lengths included, adds up.

    After the version come five positive integers or more (RSA, DSA), an octet string of a scalar's
    size (EC), or an algorithm's name and an octet string that is opened and must hold a key, a
    scalar or an integer itself (PKCS #8).
    """
    outer = _nested(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    inner = _der_items(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2 or inner[0][0] != _INTEGER or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 3:
        return False
    tag, a, b = inner[1]
    tagged = lambda rest: all(t & 0xC0 == 0x80 for t, _, _ in rest)
    if tag == _INTEGER:
        return len(inner) >= 6 and all(t == _INTEGER and _is_positive(data, x, y) for t, x, y in inner[1:6]) and all(t in (_INTEGER, _SEQUENCE) for t, _, _ in inner[6:])
    if tag == _OCTETS:
        return 16 <= b - a <= 66 and tagged(inner[2:])
    if tag != _SEQUENCE or len(inner) < 3 or inner[2][0] != _OCTETS or not depth or not tagged(inner[3:]):
        return False
    name = _der_items(data, a, b)
    body = data[inner[2][1] : inner[2][2]]
    own = _der_items(body, 0, len(body))
    if not name or name[0][0] != _NAME or name[0][1] == name[0][2] or not own or len(own) != 1:
        return False
    kind, x, y = own[0]
    return kind == _OCTETS and 16 <= y - x <= 66 or kind == _INTEGER and _is_positive(body, x, y) or is_der_key(body, depth - 1)


def is_encrypted_key(data: bytes | None) -> bool:
    """An encrypted PKCS #8 key: an algorithm's name with parameters, and an octet string."""
    outer = _nested(data, 0, len(data)) if data else None
    inner = _der_items(data, outer[0][1], outer[0][2]) if outer and len(outer) == 1 and outer[0][0] == _SEQUENCE else None
    if not inner or [t for t, _, _ in inner] != [_SEQUENCE, _OCTETS] or inner[1][2] - inner[1][1] < 16:
        return False
    name = _der_items(data, inner[0][1], inner[0][2])
    return bool(name) and name[0][0] == _NAME


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH private key format: its magic, then fields whose lengths fit."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    for field in range(4):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if field == 3:
            break
        at += n
    for _ in range(n + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return 1 <= n <= 16 and at <= len(data)


def decode_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Three parts; the first two decode to JSON objects and the first names an algorithm."""
    parts = text.split(".")
    objects = []
    for part in parts[:2]:
        data = decode_base64(part)
        try:
            objects.append(json.loads(data.decode()) if data else None)
        except (ValueError, RecursionError):
            return False
    return len(parts) == 3 and all(isinstance(x, dict) for x in objects) and isinstance(objects[0].get("alg"), str)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_der_key(data) else "openssh_key" if is_openssh_key(data) else None


def armoured(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, label, headers, body) of what stands between begin and end lines of one label."""
    at = 0
    while begin := _BEGIN.search(text, at):
        at = first = begin.end()
        while line := _HEADER.match(text, at):
            at = line.end()
        body = _BODY.match(text, at)
        if body and text.startswith(last := f"-----END {begin[1]}-----", body.end()):
            yield begin.start(), body.end() + len(last), begin[1], text[first:at], body[0]
            at = body.end() + len(last)
        else:
            at = first


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of candidates that parse as keys or tokens."""
    out = []
    inside: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for start, end, name, headers, body in armoured(text):
            data = decode_base64("".join(re.sub(r"\\[nr]", "", body).split()))
            cipher = _CIPHER.search(headers.replace("\\n", "\n")) if "ENCRYPTED" in headers else None
            # an encrypted body is whole blocks, as long as the start value
            blocks = cipher and data and len(data) >= 32 and len(data) % (len(cipher[2]) // 2) == 0
            if key_kind(data) or name.startswith("ENCRYPTED") and is_encrypted_key(data) or blocks:
                out.append((start, end, "pem_key"))
                inside.append((start, end))
    if "eyJ" in text:
        out += [(m.start(), m.end(), "signed_token") for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    for m in _BASE64.finditer(text):
        # a DER sequence begins with 0x30, the OpenSSH magic with "open": the first characters tell
        if m[0][0] == "M" or m[0].startswith("b3BlbnNzaC1rZXktdjE"):
            kind = key_kind(decode_base64(m[0]))
            before = bisect_right(inside, (m.start(), len(text)))
            if kind and not (before and m.start() < inside[before - 1][1]):
                out.append((m.start(), m.end(), kind))
    for m in _HEX_BLOB.finditer(text):
        if m[0][:2] == "30" or m[0][:8].lower() == "6f70656e":
            kind = key_kind(bytes.fromhex(m[0]))
            if kind:
                out.append((m.start(), m.end(), kind))
    return out


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), code points, by start, then in the order of KINDS."""
    text = text or ""
    found = set(base_spans(text)) | set(confirmed_spans(text))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row for each row of docs; no shuffle.

    Null and empty texts have no spans. Texts are scanned whole; each row is judged alone, so
    ids may be null or repeated. An empty table gives an empty result.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _rows, "id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets' spans."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "id", *(count(k) for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every span of text_col replaced by the mask; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for text in batch.column(at).to_pylist():
                if text is not None:
                    kept, last = [], 0
                    for a, b, _ in spans_of(text):
                        if a >= last:
                            kept += [text[last:a], mask]
                        last = max(last, b)
                    text = "".join([*kept, text[last:]])
                out.append(text)
            columns = [*batch.columns]
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def base_digest(text: str | None) -> str:
    """base_sha256 of one text."""
    spans = [s for s in spans_of(text) if s[2] in KINDS[:3]]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
