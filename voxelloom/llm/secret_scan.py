"""Secret scans: pattern matches, plus candidates confirmed by their structure.

Three patterns are reported as they match (`assign`, `access`, `hex`). Beyond these, base64 and hex runs
are decoded and reported only when the bytes parse as a private key or a signed token:

* `pem`: an armoured block whose body decodes to a private-key structure,
* `jwt`: three dotted base64url parts whose header is a JSON object naming an algorithm and whose
  payload is a JSON object,
* `key64`, `keyhex`: a bare run that decodes to a DER private key or an OpenSSH private key, every
  nested length fitting its parent exactly.

The smallest structure that is accepted, an elliptic-curve key of 16 bytes, has 23 bytes, so runs of fewer than 31
base64 or 46 hexadecimal characters can't hold one and aren't decoded.

Null or empty texts have no findings. Every row gives one row, repeated and null ids too; an empty table gives none. Only
doc_id and text are read, so other columns' names don't matter. Findings of one start are listed by kind, and findings
of different kinds may overlap. A text is searched whole whatever its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm._text import id_and_text, light_batches, tidy

#: In the order in which findings with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "key64", "keyhex")

#: For text whose A-Z are lower-cased, which keeps every place and lets the engine look for plain letters.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_JWT = re.compile(r"e(?<![A-Za-z0-9_-]e)[wy][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{31,}={0,2}")
_RUNHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){23,}(?![0-9A-Fa-f])")

FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = "doc_id long, findings array<struct<kind:string,start:int,end:int>>"


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element, or None unless the lengths fill `data` exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def _integers(items: list[tuple[int, bytes]], n: int) -> bool:
    return len(items) >= n and all(tag == 2 and body for tag, body in items[:n])


def _nested(data: bytes, tag: int) -> list[tuple[int, bytes]] | None:
    """Elements of the only element of `data`, if it has that tag."""
    outer = der_items(data)
    return der_items(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == tag else None


def _is_algorithm(data: bytes) -> bool:
    """An object identifier, whose last byte ends its last number, and at most one parameter."""
    items = der_items(data)
    return bool(items) and len(items) <= 2 and items[0][0] == 6 and len(items[0][1]) >= 2 and items[0][1][-1] < 0x80


def _is_sec1(items: list[tuple[int, bytes]]) -> bool:
    """Version 1, the key, then at most the curve ([0], an identifier or a sequence) and the public point ([1], bits)."""
    if items[0] != (2, b"\1") or items[1][0] != 4 or len(items[1][1]) < 16:
        return False
    rest = items[2:]
    if rest and rest[0][0] == 0xA0:
        curve = der_items(rest[0][1])
        if not curve or len(curve) != 1 or curve[0][0] not in (6, 0x30):
            return False
        rest = rest[1:]
    if rest and rest[0][0] == 0xA1:
        point = der_items(rest[0][1])
        if not point or len(point) != 1 or point[0][0] != 3 or point[0][1][:1] != b"\0":
            return False
        rest = rest[1:]
    return not rest


def _is_inner_key(data: bytes) -> bool:
    """What PKCS#8 wraps: a PKCS#1 or SEC 1 key, one integer, a string of octets, or a sequence of integers and strings."""
    if (items := _nested(data, 0x30)) is not None:
        if len(items) < 2:
            return False
        sec1 = items[0] == (2, b"\1") and items[1][0] == 4
        return _is_sec1(items) if sec1 else all(tag in (2, 4) and body for tag, body in items)
    outer = der_items(data)
    return bool(outer) and len(outer) == 1 and outer[0][0] in (2, 4) and len(outer[0][1]) >= 16


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1 and DSA (integers), SEC 1 (version 1, octets), PKCS#8 plain (the inner key parsed too) or encrypted."""
    items = _nested(data, 0x30)
    if not items or len(items) < 2:
        return False
    tags = [tag for tag, _ in items]
    if tags[0] == 2 and items[0][1] in (b"\0", b"\1"):
        if tags[:3] == [2, 0x30, 4]:
            return _is_algorithm(items[1][1]) and _is_inner_key(items[2][1]) and all(tag in (0xA0, 0x81, 0xA1) for tag in tags[3:])
        if tags[1] == 4:
            return _is_sec1(items)
        return _integers(items, 9) or (len(items) == 6 and _integers(items, 6))
    if tags == [0x30, 4]:
        return _is_algorithm(items[0][1]) and len(items[1][1]) >= 16 and len(items[1][1]) % 8 == 0
    return False


def is_openssh_private_key(data: bytes) -> bool:
    """The magic, three strings, a key count, the public keys and the private block, to the last byte."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or any(not string() for _ in range(keys)):
        return False
    return bool(string()) and at == len(data)


def _decode64(run: str) -> bytes:
    run = run.rstrip("=")
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return b""


def is_private_key(data: bytes) -> bool:
    return is_der_private_key(data) or is_openssh_private_key(data)


def is_signed_token(run: str) -> bool:
    parts = run.split(".")
    try:
        header, payload = (json.loads(_decode64(x)) for x in parts[:2])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return bool(_decode64(parts[2])) or header["alg"].lower() == "none"


def scan_text(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of kind, kind, end) of each finding, in order; places count characters."""
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(folded) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), "pem", m.end()) for m in _PEM.finditer(text) if is_private_key(_decode64("".join(m[2].split())))]
    found += [(m.start(), "jwt", m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    runs = [*_RUN64.finditer(text)]
    found += [(m.start(), "key64", m.end()) for m in runs if m[0][0] in "Mb" and is_private_key(_decode64(m[0]))]
    if runs:  # a hex run that is long enough lies in one of them
        found += [(m.start(), "keyhex", m.end()) for m in _RUNHEX.finditer(text) if is_private_key(bytes.fromhex(m[0]))]
    return sorted((start, KINDS.index(kind), kind, end) for start, kind, end in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for s, _, k, e in scan_text(text.as_py() or "")] for text in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, FINDINGS)], ["doc_id", "findings"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and `findings`, ordered by start, then kind as in KINDS; one row per row of `docs`."""
    return id_and_text(docs).mapInArrow(_scan, _SCHEMA)


def joined(findings: Column) -> Column:
    """kind:start:end of all findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and digests of the spans of `find_secrets`."""
    n = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long")
    base = F.filter("findings", lambda x: x.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def _redact(mask: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for value in batch.column(at):
                text, parts, done = value.as_py(), [], 0
                for start, _, _, end in scan_text(text or ""):
                    if end > done:
                        if start >= done:
                            parts += [text[done:start], mask]
                        done = end
                out.append(text if text is None or not parts else "".join(parts) + text[done:])
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(out, pa.string()))

    return tidy(task)


def redact_secrets(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """`docs` with each stretch of overlapping findings replaced by `mask`; other columns and null texts stay."""
    return light_batches(docs).mapInArrow(_redact(mask), docs.schema)
