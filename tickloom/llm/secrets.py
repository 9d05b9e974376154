"""Secret scan: keyword automaton, regular expressions only at its hits, then checksums.

Base kinds are ``assign`` (a secret word, ``=`` or ``:`` and a value), ``access``
(AKIA access ids) and ``hex`` (long lower-case hex runs). The further kinds carry
their own proof: ``github`` and ``npm`` tokens end in a base-62 CRC-32 of their
body, ``jwt`` headers must decode to JSON with an algorithm, ``pem`` bodies must
be base64 that begins as a DER sequence or an OpenSSH key, or be called encrypted
by their header lines.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_arrow
from .words import slices, text_view

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(rb"[0-9a-f]{24,}")
# Keywords in lower case, by the kind whose pattern is tried at a hit.
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "jwt": ["eyj"],
    "pem": ["-----begin "],
}
PATTERNS = {
    "assign": ASSIGN,
    "access": ACCESS,
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    # A header has at most 4,096 characters, so that many starts in one run of letters cost no more than that each.
    "jwt": re.compile(rb"eyJ[A-Za-z0-9_-]{1,4093}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    # Header lines don't hold five hyphens, so that none is read for more than one key.
    "pem": re.compile(rb"-----BEGIN ([A-Z ]*?)PRIVATE KEY-----\s++((?:[A-Za-z][A-Za-z0-9-]*+:\x20(?:(?!-----)[^\r\n])*+\r?\n)*+)([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----"),
}
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def base62_crc(body: bytes) -> str:
    """CRC-32 in base 62, six digits."""
    n, out = zlib.crc32(body), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0")


def _json_header(m: re.Match) -> bool:
    head = m[0].split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError, binascii.Error):
        return False


def _key_body(m: re.Match) -> bool:
    """Base64 of a DER sequence or an OpenSSH key; what header lines call encrypted can begin with any byte."""
    try:
        body = base64.b64decode(b"".join(m[3].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    return body[:1] == b"\x30" or body.startswith(b"openssh-key-v1\0") or (len(body) > 0 and b"ENCRYPTED" in m[2])


VALID = {
    "assign": lambda m: len(m[2]) >= ASSIGN_LEAST,
    "access": lambda m: len(m[0]) >= ACCESS_LEAST,
    "github": lambda m: base62_crc(m[0][4:34]) == m[0][34:].decode(),
    "npm": lambda m: base62_crc(m[0][4:34]) == m[0][34:].decode(),
    "jwt": _json_header,
    "pem": _key_body,
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def find_secrets(text: bytes, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Spans (start, index of kind, end) in bytes, sorted; leftmost and not overlapping within a kind."""
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in keywords.iter(text.lower().decode("latin-1")))
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    free = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at >= free[kind] and (m := PATTERNS[kind].match(text, at)):
            valid = VALID[kind](m)
            if valid or kind in BASE:
                free[kind] = m.end()
            if valid:
                found.append((at, KINDS.index(kind), m.end()))
    return sorted(found)


def _in_characters(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or not (text & 0x80).any():
        return spans
    chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [(int(chars[a]), k, int(chars[b])) for a, k, b in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text, without a shuffle.

    Returns one row per input row: the id and ``spans``, an array of ``kind,
    start, end`` in code points, end exclusive, sorted by start, then by kind in
    the order of ``KINDS``. Null and empty texts have no spans; texts of any
    length are scanned whole, in time that grows with the length. Spans of
    different kinds may overlap, those of one kind don't. Other columns are
    ignored; repeated rows are scanned each; an empty table gives an empty result.
    """
    kind_of_id = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            for part in slices(batch, 1):
                data, at = text_view(part.column(1))
                spans = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    one = data[a:b]
                    spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in _in_characters(one, find_secrets(one.tobytes(), keywords))])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["id", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, f"id {kind_of_id.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)
