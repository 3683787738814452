"""Secret scans with structural confirmation.

Patterns find candidates; base64 and hex candidates are decoded and confirmed by structure: key encodings
(DER whose nested lengths add up, OpenSSH containers), private-key blocks, signed tokens with a JSON
header. Spans of the three base kinds are reported as the patterns have them; structures are further
spans, and reported only if confirmed.

Every step takes time in proportion to the text, whatever it holds: runs are matched once, from where they
begin, and decoded once for each of the four ways in which a start can lie in a base64 run; from each start
only the headers of a key's few elements are read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so a minimum length is all there is to drop
ANY_HEX = re.compile(r"[0-9A-Fa-f]{20,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]+")
#: 0x30, a sequence's tag, is M and a letter up to P in base64.
SEQUENCE = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]{6})")
#: A run of base64 from where it begins, maybe wrapped over lines.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)*+")
#: Three segments with dots between them; the first may be a token's header or end with one.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{10,}+)\.[A-Za-z0-9_-]++\.([A-Za-z0-9_-]*+))")
SPACE = re.compile(r"[ \t\r\n]*+")
READER = json.JSONDecoder()
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:(?!-----)[\s\S])*)-----END \1-----")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, padding optional."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, end) of the DER element at `at`, if it fits before `end`."""
    if at + 2 > end:
        return None
    size, start = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end or data[start] == 0:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (data[at], start, start + size) if start + size <= end else None


def _elements(data: bytes, at: int, end: int, depth: int) -> int:
    """How many elements fill from `at` up to `end`, nested ones checked as deep as keys go; 0 if lengths don't add up or there are more than any key has."""
    n, last = 0, end - 1
    while at < last:
        n += 1
        if n > 16:
            return 0
        size = data[at + 1]
        if size < 0x80:
            start = at + 2
            past = start + size
        else:
            x = _element(data, at, end)
            if x is None:
                return 0
            _, start, past = x
        # An element that holds elements; an empty one holds none.
        if data[at] & 0x20 and (past > end or depth == 0 or start < past and not _elements(data, start, past, depth - 1)):
            return 0
        at = past
    return n if at == end else 0


def key_encoding(data: bytes, at: int = 0) -> int:
    """The end of the key encoding at `at`, or -1: a DER sequence of two or more elements that begins with a version or with an algorithm, nested lengths adding up at every level."""
    outer = _element(data, at, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] - outer[1] < 8:
        return -1
    first = _element(data, outer[1], outer[2])
    if first is None or first[1] == first[2] or not (first[0] == 0x02 or first[0] == 0x30 and data[first[1]] == 0x06):  # an algorithm begins with its number
        return -1
    return outer[2] if _elements(data, outer[1], outer[2], 4) >= 2 else -1


def is_key_encoding(data: bytes) -> bool:
    return key_encoding(data) == len(data)


def is_openssh(data: bytes) -> bool:
    """OpenSSH's container: its magic, then cipher, key derivation and its options as strings whose lengths fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data):
            return False
    return int.from_bytes(data[at : at + 4], "big") >= 1


def is_key_block(body: str) -> bool:
    """What stands between a private key's marks: header lines, then base64 of a key encoding, of OpenSSH's form or, where a header says so, of a cipher's blocks. Line ends may be escaped."""
    lines = re.sub(r"\\+[nr]", "\n", body).split("\n")
    head = [x for x in lines if ":" in x]
    data = decoded(re.sub(r"\s", "", "".join(x for x in lines if ":" not in x)))
    if not data:
        return False
    return is_key_encoding(data) or is_openssh(data) or (any("ENCRYPTED" in x for x in head) and len(data) % 8 == 0)


class _Phases:
    """A base64 run read from any of its characters: starts that are a multiple of four apart share one decoding."""

    def __init__(self, run: str):
        self.run, self.known = run.replace("-", "+").replace("_", "/"), {}

    def at(self, k: int) -> tuple[bytes, int]:
        """(bytes, where character k begins in them)."""
        phase = k % 4
        if phase not in self.known:
            some = self.run[phase:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            self.known[phase] = base64.b64decode(some + "=" * (-len(some) % 4))
        return self.known[phase], (k - phase) // 4 * 3


def _object(text: str, at: int) -> tuple[object, int] | None:
    """(JSON value at `at`, its end), read in growing pieces: an error's message costs time in proportion to what was handed over."""
    size = 512
    while True:
        some = text[at : at + size]
        try:
            value, end = READER.raw_decode(some)
            return value, at + end
        except json.JSONDecodeError as e:
            if at + size >= len(text) or (e.pos < len(some) - 8 and not e.msg.startswith("Unterminated")):
                return None
        except RecursionError:
            return None
        size *= 4


def header_start(segment: str) -> int:
    """Where the JSON header of a signed token begins that ends with the segment, or -1: an object with an alg, from the segment's start or from a brace inside it."""
    phases, texts = _Phases(segment), {}
    for k in [0, *(m.start() for m in re.finditer("e[yw]", segment))]:
        if (len(segment) - k) % 4 == 1:
            continue
        data, at = phases.at(k)
        if k % 4 not in texts:
            texts[k % 4] = data.decode("latin-1"), data.rfind(b'"alg"')
        text, alg = texts[k % 4]
        if alg < at:
            continue
        if k == 0:
            at = SPACE.match(text).end()
        got = _object(text, at)
        if got and isinstance(got[0], dict) and isinstance(got[0].get("alg"), str) and SPACE.match(text, got[1]).end() == len(text):
            return k
    return -1


def is_signed_token(text: str) -> bool:
    head = text.split(".", 1)[0]
    return re.fullmatch(r"[A-Za-z0-9_-]{10,}", head) is not None and header_start(head) == 0


def key_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of base64 key encodings: from any place in a run, maybe wrapped over lines, up to where its characters end."""
    end = past = 0
    for m in SEQUENCE.finditer(text):
        at = m.start()
        if at < end:
            continue
        if at >= past:  # a new run
            begin, past = at, WRAPPED.match(text, at).end()
            run = text[at:past]
            places = None if BASE64.fullmatch(run) else [x for x, c in enumerate(run) if c not in " \t\r\n"]
            phases = _Phases(run if places is None else "".join(run.split()))
        k = at - begin if places is None else bisect_left(places, at - begin)
        data, start = phases.at(k)
        stop = key_encoding(data, start)
        if stop < 0:
            continue
        count = -(-(stop - start) * 4 // 3)
        last = k + count - 1
        close = begin + (last if places is None else places[last]) + 1
        if BASE64.match(text, close):
            continue
        end = close + len(re.match("={0,%d}" % (-count % 4), text[close : close + 2])[0])
        yield at, end


def scan(text: str | None) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, confirmed) in code points, end exclusive, by start and then kind."""
    text = text or ""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign", is_signed_token(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", len(m[0]) == 20) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    for m in HEX.finditer(text):
        der = len(m[0]) % 2 == 0 and is_key_encoding(bytes.fromhex(m[0]))
        out.append((m.start(), m.end(), "hex", der))
        if der:
            out.append((m.start(), m.end(), "der", True))
    if "-----BEGIN " in text:
        out += [(m.start(), m.end(), "pem", True) for m in PEM.finditer(text) if is_key_block(m[2])]
    for m in SIGNED.finditer(text):
        k = header_start(m[1])
        if k >= 0:
            out.append((m.start() + k, m.end(2), "jwt", True))
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and not HEX.fullmatch(m[0]) and is_key_encoding(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "der", True))
    out += [(a, b, "der", True) for a, b in key_spans(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, confirmed>>) of every row, whole texts. A narrow pass that reads doc_id and text only.

    Null and empty texts have no span; repeated ids are rows of their own; an empty table gives an empty
    result. Spans are ordered by start, then by kind as listed, then by end; they may overlap.
    """
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("confirmed", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind", "confirmed")
        for batch in slices(parts):
            rows = [[dict(zip(names, x)) for x in scan(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string,confirmed:boolean>>")

