"""Vectorised word hashes over Arrow text, without a Python object per word.

A word's hash chains a 64-bit finaliser over its bytes, eight at a time, and its
length; of a word of more than ``LONG`` bytes it is BLAKE2 of the bytes. Separators
are ASCII, so splitting bytes and splitting characters agree in UTF-8. Two seeds
give hashes that are independent of each other: one for searching, the other to
confirm what was found, so that a false result takes 128 equal bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
SLICE_BYTES = 1 << 21
LONG = 256
#: The seed of the second hash.
CONFIRM = 0x5851F42D4C957F2D
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Alphabet:
    """Which bytes make words; A to Z count as a to z."""

    def __init__(self, is_word: np.ndarray):
        self.is_word = is_word
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] = self.lower[97:123]


def spaced() -> Alphabet:
    """Words of all bytes but space and 0x09 to 0x0D."""
    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    return Alphabet(is_word)


def alphanumeric() -> Alphabet:
    """Words of ASCII digits and letters and of all bytes from 0x80."""
    is_word = np.zeros(256, bool)
    is_word[0x30:0x3A] = is_word[0x41:0x5B] = is_word[0x61:0x7B] = is_word[0x80:] = True
    return Alphabet(is_word)


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each range of lower-cased bytes; a word costs a step for every eight of its bytes."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunks = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, 0, (1,))  # the eight bytes from each position
    out = mix(size.astype(_U) * _U(0xA0761D6478BD642F) + _U(seed))
    live = np.flatnonzero(size <= LONG)
    at = 0
    while len(live):
        rest = np.minimum(size[live] - at, 8).astype(_U)
        chunk = chunks[starts[live] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - (rest << _U(3))))
        out[live] = mix((out[live] ^ chunk) * _U(0xE7037ED1A0B428DB) + _U(seed))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return np.maximum(out, _U(1))


def word_hashes(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, *seeds: int | tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, by seed, and for each text the index of its first word (one more entry than texts).

    No hash of a word is 0. A seed with a number n gives hashes of the first n
    bytes, and 0 for words that have no more.
    """
    lo, end = int(offsets[0]), int(offsets[-1])
    seeds = seeds or (0,)
    hashes, starts = [[] for _ in seeds], []
    while lo < end:
        size = BLOCK
        while True:  # the block must end between words
            hi = min(lo + size, end)
            inside = alphabet.is_word[data[lo:hi]]
            if hi == end:
                break
            breaks = np.flatnonzero(~inside)
            edge = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            cut = max(lo + int(breaks[-1]) + 1 if len(breaks) else lo, edge if edge > lo else lo)
            if cut > lo:
                hi, inside = cut, inside[: cut - lo]
                break
            size *= 2
        n = hi - lo
        fresh = np.zeros(n + 1, bool)  # a text begins here
        fresh[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside
        after = np.empty(n + 1, bool)
        after[:n], after[n] = inside, False
        s = np.flatnonzero(after & (~before | fresh))
        e = np.flatnonzero(before & (~after | fresh))
        low = alphabet.lower[data[lo:hi]]
        for out, seed in zip(hashes, seeds, strict=True):
            if isinstance(seed, tuple):
                out.append(np.where(e - s > seed[1], _hash(low, s, np.minimum(e, s + seed[1]), seed[0]), _U(0)))
            else:
                out.append(_hash(low, s, e, seed))
        starts.append(s + lo)
        lo = hi
    if not starts:
        return *(np.zeros(0, _U) for _ in seeds), np.zeros(len(offsets), np.int64)
    return *(np.concatenate(h) for h in hashes), np.searchsorted(np.concatenate(starts), offsets)


_STEP = mix(np.arange(1, 65, dtype=_U) * _U(0xE7037ED1A0B428DB)) | _U(1)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words, by the index of its first."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, length * 0x8EBC6AF09C88C6E3 % (1 << 64), _U)
    for k in range(length):
        out += words[k : k + n] * _STEP[k]
    return mix(out)
