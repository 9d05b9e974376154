"""Benchmark decontamination by suffix arrays over the training texts.

Each shard (a slice of a partition) gets the suffix array of all its word
suffixes, by prefix doubling over the words' hashes; a suffix ends with its text.
Every benchmark suffix is then found by binary search, word by word, for all
suffixes at once. A window that occurs is handled once, whatever number of items
share it, and confirmed under a second hash of the words; from there the longest
verbatim match is searched in the benchmark's sorted suffixes. The benchmark comes
in blocks; a worker holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended, map_arrow, unused, without
from .words import CONFIRM, alphanumeric, mix, slices, text_view, word_hashes

WINDOW = 10
BLOCK_WORDS = 1_000_000
_U = np.uint64


@dataclass
class TestSuffixes:
    """The words of a block of benchmark pieces, one after another, and its suffixes that hold a window, sorted by all their words.

    By word: its hashes, its piece and the end of that piece. By suffix: its place
    among the words and the words of its window. By piece: its first word, where
    it begins in its item, and its item's place in ``names``, which are sorted.
    """

    __test__ = False
    words: np.ndarray
    confirm: np.ndarray
    piece: np.ndarray
    end: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    name: np.ndarray
    names: list[str]


def _block(texts: list[str], names: list[str], offset: list[int]) -> TestSuffixes | None:
    words, confirm, first = word_hashes(*text_view(pa.array(texts, pa.large_string())), alphanumeric(), 0, CONFIRM)
    sizes = np.diff(first)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    if not len(piece):
        return None
    end, window = first[1:][piece], np.minimum(sizes, WINDOW)[piece]
    start = suffix_array(words, end)
    start = start[start + window[start] <= end[start]]
    known = sorted(set(names))
    place = {name: i for i, name in enumerate(known)}
    return TestSuffixes(words, confirm, piece, end, start, window[start], first[:-1], np.array(offset), np.array([place[n] for n in names]), known)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """A text in pieces of at most about ``BLOCK_WORDS`` words and the word at which each begins.

    Pieces overlap by a window less one word, so that each window is whole in one.
    """
    if len(text) <= 2 * BLOCK_WORDS:
        yield 0, text
        return
    data, offsets = text_view(pa.array([text], pa.large_string()))
    alphabet = alphanumeric()
    inside = alphabet.is_word[data[offsets[0] : offsets[1]]]
    begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    raw = data[offsets[0] : offsets[1]].tobytes()
    for a in range(0, max(1, len(begins) - WINDOW + 1), BLOCK_WORDS):
        b = a + BLOCK_WORDS + WINDOW - 1
        yield a, raw[begins[a] if len(begins) else 0 : begins[b] if b < len(begins) else len(raw)].decode()


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Broadcast]:
    """Broadcast the benchmark's suffixes in blocks of at most about ``BLOCK_WORDS`` words.

    Items stream to the driver one partition at a time, long ones in pieces, so a
    block is bounded however large the benchmark or an item is. Blocks lie on the
    disks of driver and executors; see ``_loaded`` for what workers hold.
    """
    spark, out, texts, names, starts, size = benchmark.sparkSession, [], [], [], [], 0

    def close() -> None:
        if texts and (block := _block(texts, names, starts)):
            out.append(spark.sparkContext.broadcast(block))

    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        for at, piece in _pieces(row[1]):
            names.append(row[0])
            texts.append(piece)
            starts.append(at)
            size += len(piece) // 2 + 1
            if size > BLOCK_WORDS:
                close()
                texts, names, starts, size = [], [], [], 0
    close()
    return out


def _loaded(blocks: list[Broadcast]) -> Iterator[TestSuffixes]:
    """The blocks one after another. One alone stays in the worker; of several, each is read from the executor's disk again and let go."""
    if len(blocks) == 1:
        yield blocks[0].value
        return
    for shared in blocks:
        yield shared.load_from_path(shared._path)


def suffix_array(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All positions, sorted by their suffixes; equal suffixes of different texts by position.

    ``last`` is the end of the text of each position; the end sorts before any
    word. Prefix doubling: in each round only suffixes that share their first k
    words with another one are sorted again, by the next k.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    if not n:
        return order
    ordered = words[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    single = new & np.r_[new[1:], True]
    slots = np.flatnonzero(~single)
    longest = int((last - np.arange(n)).max())
    k = 1
    while len(slots) and k < longest:
        at = order[slots]
        after = np.minimum(at + k, n - 1)
        key = rank[at] * (n + 1) + np.where(at + k < last[at], rank[after], 0)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        slots = slots[~(new & np.r_[new[1:], True])]
        k *= 2
    return order


def narrowed(words: np.ndarray, end: np.ndarray, array: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ranges of a suffix array, equal in their first k words, whose next word is the wanted one; by binary search."""

    def bound(right: bool) -> np.ndarray:
        low, high = lo.copy(), hi.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            at = array[mid]
            value = np.where(at + k < end[at], words[np.minimum(at + k, len(words) - 1)], _U(0))
            less = (value <= want[open_]) if right else (value < want[open_])
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    return bound(False), bound(True)


def search(words: np.ndarray, last: np.ndarray, array: np.ndarray, block: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test suffixes whose whole window occurs, in order, and the range of the suffix array in which it does."""
    heads = words[array]
    want = block.words[block.start]
    lo, hi = np.searchsorted(heads, want, "left"), np.searchsorted(heads, want, "right")
    live = np.flatnonzero(lo < hi)
    lo, hi = lo[live], hi[live]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(1, WINDOW + 1):
        whole = block.length[live] == k
        done.append((live[whole], lo[whole], hi[whole]))
        live, lo, hi = live[~whole], lo[~whole], hi[~whole]
        if not len(live):
            break
        lo, hi = narrowed(words, last, array, k, lo, hi, block.words[block.start[live] + k])
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
    which, lo, hi = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(which)
    return which[order], lo[order], hi[order]


@dataclass
class Windows:
    """Distinct windows that occur: a suffix that begins with each, all suffixes that do (a range of the block's), its ranges of the shard's array, its length, and its items."""

    example: np.ndarray
    members: tuple[np.ndarray, np.ndarray]
    lo: np.ndarray
    hi: np.ndarray
    length: np.ndarray
    items: list[np.ndarray]


def distinct_windows(block: TestSuffixes, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Windows:
    """Found suffixes with one window each: equal ranges, length and second hashes. Each window is then handled once, whatever number of items share it."""
    length, confirm = block.length[which], np.zeros(len(which), _U)
    for k in range(WINDOW):
        inside = np.flatnonzero(k < length)
        confirm[inside] = mix(confirm[inside] + block.confirm[block.start[which[inside]] + k] + _U(1))
    order = np.lexsort((which, confirm, length, hi, lo))
    key = np.stack([lo, hi, length, confirm.view(np.int64)])[:, order]
    new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    example, member = which[order[at]], which[order]
    pairs = np.unique(group * len(block.names) + block.name[block.piece[block.start[member]]])
    cuts = np.searchsorted(pairs // len(block.names), np.arange(1, len(at)))
    items = np.split(pairs % len(block.names), cuts)
    return Windows(example, (np.minimum.reduceat(member, at), np.maximum.reduceat(member, at) + 1), lo[order[at]], hi[order[at]], length[order[at]], items)


def occurrences(array: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's number with each position that it holds; a position is in at most ``WINDOW`` ranges of distinct windows."""
    sizes = hi - lo
    return np.repeat(np.arange(len(lo)), sizes), array[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)]


def longest_matches(words: np.ndarray, confirm: np.ndarray, first: np.ndarray, last: np.ndarray, block: TestSuffixes, found: Windows, group: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, lengths and test suffixes of longest matches that together cover all windows found.

    In each run of positions at which a window begins, the first match is the
    longest from the run's first position, and each further one the longest from
    the first position whose window isn't covered yet. Lengths come from narrowing
    the benchmark's own sorted suffixes word by word, so the work is in proportion
    to the words matched and not to the items that share them.
    """
    by = np.argsort(found.length[group], kind="stable")
    own = np.full(len(words), -1)
    own[pos[by]] = group[by]
    begins = np.flatnonzero(own >= 0)
    size = found.length[own[begins]]
    heads = np.flatnonzero((begins == first[begins]) | np.r_[True, begins[1:] != begins[:-1] + 1])
    is_head = np.zeros(len(begins) + 1, bool)
    is_head[heads] = True
    is_head[-1] = True
    runs_at = np.flatnonzero(is_head)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(heads):
        at, g = begins[heads], own[begins[heads]]
        length, lo, hi, example = found.length[g].copy(), found.members[0][g].copy(), found.members[1][g].copy(), found.example[g].copy()
        live, k = np.flatnonzero(length == WINDOW), WINDOW
        while len(live := live[at[live] + k < last[at[live]]]):
            a, b = narrowed(block.words, block.end, block.start, k, lo[live], hi[live], words[at[live] + k])
            live, a, b = live[a < b], a[a < b], b[a < b]
            lo[live], hi[live], length[live], example[live] = a, b, k + 1, a
            k += 1
        agreed, live, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(live := live[k < length[live]]):
            live = live[confirm[at[live] + k] == block.confirm[block.start[example[live]] + k]]
            k += 1
            agreed[live] = k
        false = agreed < found.length[g]
        example[false], agreed[false] = found.example[g[false]], found.length[g[false]]
        out.append((at, agreed, example))
        until = at + agreed
        step = np.maximum(heads + 1, np.searchsorted(begins, until - WINDOW + 1))
        while True:
            inside = np.flatnonzero(step < len(begins))
            covered = inside[~is_head[step[inside]] & (begins[step[inside]] + size[step[inside]] <= until[inside])]
            if not len(covered):
                break
            step[covered] += 1
        heads = step[step < runs_at[np.searchsorted(runs_at, heads, "right")]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _uncovered(found: list[tuple[int, int, str, int]]) -> list[dict]:
    """Matches as they begin, without those inside another, which further blocks may give."""
    out, until = [], 0
    for start, minus, name, item_start in sorted(found):
        if start - minus > until:
            until = start - minus
            out.append({"item_id": name, "doc_start": start, "item_start": item_start, "words": -minus})
    return out


def _scan(part: pa.RecordBatch, text: int, blocks: list[Broadcast], alphabet) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    data, at = text_view(part.column(text))
    words, bounds = word_hashes(data, at, alphabet)
    n, docs = len(words), part.num_rows
    doc_of = np.repeat(np.arange(docs), np.diff(bounds))
    first, last = bounds[:-1][doc_of], bounds[1:][doc_of]
    edge = np.zeros(n + 1, np.int64)
    lists: list[list[str]] = []  # items that share a window, each list once
    held: list[set[int]] = [set() for _ in range(docs)]
    matches: list[list[tuple[int, int, str, int]]] = [[] for _ in range(docs)]
    array = suffix_array(words, last) if blocks and n else None
    confirm = None
    for block in _loaded(blocks) if n else ():
        hits = search(words, last, array, block)
        if not len(hits[0]):
            continue
        if confirm is None:
            confirm, _ = word_hashes(data, at, alphabet, CONFIRM)
        found = distinct_windows(block, *hits)
        group, pos = occurrences(array, found.lo, found.hi)
        same, length = np.ones(len(pos), bool), found.length[group]
        for k in range(WINDOW):
            inside = np.flatnonzero(k < length)
            same[inside] &= confirm[pos[inside] + k] == block.confirm[block.start[found.example[group[inside]]] + k]
        group, pos, length = group[same], pos[same], length[same]
        if not len(pos):
            continue
        edge += np.bincount(pos, minlength=n + 1) - np.bincount(pos + length, minlength=n + 1)
        known: dict[bytes, int] = {}
        shared = np.array([known.setdefault(ids.tobytes(), len(lists) + len(known)) for ids in found.items])
        lists += [[block.names[i] for i in np.frombuffer(ids, np.int64)] for ids in known]
        for key in np.unique(doc_of[pos] * len(lists) + shared[group]).tolist():
            held[key // len(lists)].add(key % len(lists))
        for p, size, s in zip(*(x.tolist() for x in longest_matches(words, confirm, first, last, block, found, group, pos)), strict=True):
            begin = int(block.start[s])
            i = int(block.piece[begin])
            matches[int(doc_of[p])].append((p - int(first[p]), -size, block.names[int(block.name[i])], begin - int(block.first[i]) + int(block.offset[i])))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n]) > 0)])
    unions: dict[frozenset[int], list[str]] = {}

    def items(which: set[int]) -> list[str]:
        key = frozenset(which)
        if key not in unions:
            unions[key] = sorted(set().union(*(lists[i] for i in which)))
        return unions[key]

    return np.diff(bounds), hit[bounds[1:]] - hit[bounds[:-1]], [items(x) for x in held], [_uncovered(x) for x in matches]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", new: tuple[str, ...] = ("n_words", "n_hit", "items", "matches")) -> DataFrame:
    """All columns of ``docs`` and ``n_words, n_hit, items, matches``, without a shuffle.

    Words are lower-cased ASCII letters, digits and everything beyond ASCII. A
    window is ``WINDOW`` consecutive words of an item, or the whole of a shorter
    item. ``n_hit`` counts document words inside any occurrence of a window,
    ``items`` are the ids (as text, sorted) with occurrences, ``matches``
    longest verbatim matches that cover all hit words, with their places in words
    and one item each of those that share the passage. Null and empty texts
    have no words; items without words match nothing; a null item id is the
    empty name; items that repeat an id count once. A very long text is a shard
    of its own; an item of over ``BLOCK_WORDS`` words is searched in pieces, and
    a longest match ends where its piece does. An input column with one of
    the new names is replaced. Repeated rows are judged each. An empty benchmark
    leaves every document clean; an empty table gives an empty result.
    """
    docs = without(docs, new)
    blocks = benchmark_blocks(benchmark, bench_id, bench_text)
    at = docs.columns.index(text_col)
    match = pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = alphanumeric()
        for batch in batches:
            for part in slices(batch, at):
                n_words, n_hit, items, matches = _scan(part, at, blocks, alphabet)
                columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(match))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *new])

    added = f"{new[0]} bigint, {new[1]} bigint, {new[2]} array<string>, {new[3]} array<struct<item_id:string,doc_start:bigint,item_start:bigint,words:bigint>>"
    return map_arrow(docs, run, extended(docs.schema, added))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without any benchmark window, with their columns, whatever their names; null and empty texts stay."""
    names = unused(docs, "n_words", "n_hit", "items", "matches")
    return find_contamination(docs, benchmark, text_col, new=names).where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
