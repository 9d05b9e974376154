"""Byte-level BPE by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can't be merged,
so every text is certain to be cut there. Fragments between certain cuts are
encoded independently and concatenated; a fragment seen before is looked up.

A cut is taken between two characters where (1) the last byte of the left and
the first of the right form such a pair, and (2) the pre-tokenizer's pattern
can't see across it: the left character isn't white space (its pattern looks
ahead from white space) and the right one isn't an apostrophe (it would begin a
contraction). Added tokens are set apart before anything else.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended, map_arrow, unused
from .words import slices, text_view

FRAGMENTS_KEPT = 500_000
LONGEST_KEPT = 64
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20]
#: The last two bytes of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE_SPACE = np.zeros((256, 256), bool)
_WIDE_SPACE[0xC2, [0x85, 0xA0]] = _WIDE_SPACE[0x9A, 0x80] = _WIDE_SPACE[0x81, 0x9F] = True
_WIDE_SPACE[0x80, [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


# The settings that certain cuts rely on.
RELIED_ON = {
    ("model", "type"): "BPE", ("model", "dropout"): None, ("model", "continuing_subword_prefix"): None, ("model", "end_of_word_suffix"): None, ("normalizer",): None, ("post_processor",): None,
    ("pre_tokenizer", "type"): "ByteLevel", ("pre_tokenizer", "add_prefix_space"): False, ("pre_tokenizer", "use_regex"): True, ("decoder", "type"): "ByteLevel",
}
NOT_SAID = {("model", "type"): "BPE"}


def _check(doc: dict) -> None:
    """Refuse a vocabulary whose settings could join what is cut here, or change the text first."""
    for path, want in RELIED_ON.items():
        value = doc
        for key in path:
            value = value.get(key, NOT_SAID.get(path)) if isinstance(value, dict) else None
        if value != want:
            raise ValueError(f"the vocabulary has {'.'.join(path)} = {value!r}; only {want!r} can be cut by forced boundaries")
    odd = [a["content"] for a in doc["added_tokens"] if any(a.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd:
        raise ValueError(f"added tokens {odd} reach beyond their own characters")


class ForcedBoundaryBpe:
    """Encoder and decoder of one byte-level vocabulary, built from the file's content."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        doc = json.loads(vocabulary)
        _check(doc)
        letters = _byte_letters()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {a["content"]: a["id"] for a in doc["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in doc["model"]["vocab"].items() if token not in self.added}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        inside = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:], strict=False):
                inside[a, b] = True
        self.certain = ~inside
        self.certain[_SPACES, :] = False
        self.certain[:, 0x27] = False
        self.certain[:, 0x80:0xC0] = False
        self._split_added = re.compile(b"(" + b"|".join(re.escape(a.encode()) for a in sorted(self.added, key=len, reverse=True)) + b")") if self.added else None
        self._ids: dict[bytes, bytes] = {}
        self._text: dict[bytes, bytes] = {}  # of the fragments that don't decode to themselves

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions of the certain cuts of UTF-8 bytes."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        cut = self.certain[data[:-1], data[1:]]
        cut[1:] &= ~_WIDE_SPACE[data[:-2], data[1:-1]]
        return np.flatnonzero(cut) + 1

    def fragments(self, text: bytes) -> list[bytes]:
        """Pieces between certain cuts; added tokens are pieces of their own."""
        if self._split_added is None or not any(a.encode() in text for a in self.added):
            return self._cut(text)
        out = []
        for k, part in enumerate(self._split_added.split(text)):
            out += [part] if k % 2 else self._cut(part) if part else []
        return out

    def _cut(self, text: bytes) -> list[bytes]:
        at = self.cuts(np.frombuffer(text, np.uint8)).tolist()
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]

    def _learn(self, fragments: list[bytes]) -> None:
        for f, e in zip(fragments, self.tokenizer.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False), strict=True):
            self._ids[f] = ",".join(map(str, e.ids)).encode()
            if (text := self.decode(e.ids).encode()) != f:
                self._text[f] = text

    def decode(self, ids) -> str:
        """Bytes of the tokens, joined; parts that aren't UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def encode_text(self, text: bytes) -> tuple[bytes, bytes]:
        """Decimal ids joined by commas, and the text that they decode to."""
        if not text:
            return b"", b""
        pieces = self.fragments(text)
        try:
            return b",".join(map(self._ids.__getitem__, pieces)), self._decoded(text, pieces)
        except KeyError:
            pass
        if len(self._ids) > FRAGMENTS_KEPT:
            self._ids.clear()
            self._text.clear()
        new = {p for p in pieces if p not in self._ids}
        self._learn(list(new))
        out = b",".join(map(self._ids.__getitem__, pieces)), self._decoded(text, pieces)
        for p in new:
            if len(p) > LONGEST_KEPT:
                del self._ids[p]
                self._text.pop(p, None)
        return out

    def _decoded(self, text: bytes, pieces: list[bytes]) -> bytes:
        """What the pieces decode to: each to what was found when it was learnt."""
        return b"".join([self._text.get(p, p) for p in pieces]) if self._text else text


def bpe_encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again, without a shuffle.

    ``vocabulary_path`` is read on the driver; its content, a few MB of fixed
    size, goes to the executors. Returns the columns ``keep`` (all by default)
    and ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``token_ids``
    and ``decoded``. A null or empty text has no tokens; texts of any length are
    encoded whole. Repeated rows are each encoded; an empty table gives an empty
    result. Input columns of these names are replaced. A vocabulary whose settings
    certain cuts can't rely on is refused.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256", *(("token_ids", "decoded") if with_ids else ()))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            if coder is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                coder = ForcedBoundaryBpe(shared.value)
            for part in slices(batch, 0):
                data, at = text_view(part.column(0))
                raw = data[at[0] : at[-1]].tobytes()
                found = [coder.encode_text(raw[a:b]) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                columns = [
                    pa.array([ids.count(b",") + 1 if ids else 0 for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(text).hexdigest() for _, text in found], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([np.array(ids.split(b","), np.int32) if ids else np.zeros(0, np.int32) for ids, _ in found], pa.list_(pa.int32())))
                    columns.append(pa.array([text.decode() for _, text in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*kept, *new])

    source = docs.select(F.col(f"`{text_col}`").alias(unused(docs, "_text")[0]), *[F.col(f"`{c}`") for c in kept])
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * with_ids
    return map_arrow(source, run, extended(schema, added))
