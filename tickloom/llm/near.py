"""Near-duplicate detection by one-permutation MinHash with optimal densification.

1. Every text's set of five-word shingles is hashed once; texts with equal sets
   are collapsed to one node by a 128-bit fingerprint of the set.
2. One hash per shingle fills ``BINS`` bins; empty bins copy the first filled bin
   of a random probe sequence that depends on the bin alone.
3. ``BANDS`` bands of ``ROWS`` bins are the buckets. Within a bucket, candidates
   are a star around its most central member, the one with the most bucket
   mates; a family of copies so shares few centres. There are at most as many
   star edges as bucket entries.
4. Every member is compared with its centre on the full sets, in blocks of a
   star's members, each with the centre: pairs and texts grow with the members.
   Links so found make parts.
5. Only stars that still have several parts go on: members outside the centre's
   part are compared with each other and with the members inside it, in blocks of
   bounded size, and only pairs whose parts differ: by size and sketch first, then
   those left on the full sets; links that join two parts are returned. Every two texts that share a bucket share its centre, so no bucket's
   pair goes untested.

At similarity s a pair shares a band with probability 1 - (1 - s^4)^32, which is
0.999995 at 0.75, if its sets fill most bins. Small sets don't, so sets of at most
``SMALL`` shingles have the shingles of their prefix as further buckets: of two
linked sets, the smaller has three quarters of the larger's shingles, so that one
of each set's smallest n - ceil(0.75 n) + 1 shingles is common to both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._shared import discard, map_arrow, materialise, unused
from .components import components
from .words import CONFIRM, mix, runs, slices, spaced, text_view, word_hashes

WORDS, PERCENT = 5, 75
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Sets with prefix buckets; all links of a set of up to three quarters of this size are found for certain.
SMALL = 32
#: Bins (of 128) that the sketches of sets of ``SKETCHED`` shingles and more must share. At a similarity of 0.75 they share 96 with a deviation of 4.9.
SKETCH_LEAST, SKETCHED = 70, 64
#: Sets of fewer than ``SKETCHED`` can be linked with sets below this size; the sketch of such sets has half of each shingle's hash too.
SHORT = SKETCHED * 100 // PERCENT + 1
#: Members and shingles of one side of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1_000_000
_U = np.uint64
Shingles = tuple[np.ndarray, np.ndarray]


def shingle_sets(part: pa.RecordBatch, text: int, alphabet) -> Iterator[Shingles]:
    """Distinct shingles of each text, sorted, under two hashes; the whole sequence as one if it has fewer words."""
    *hashes, first = word_hashes(*text_view(part.column(text)), alphabet, 0, CONFIRM)
    all_runs = [runs(words, WORDS) for words in hashes]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield tuple(np.unique(r[a : b - WORDS + 1]) for r in all_runs)
        else:
            yield tuple(runs(words[a:b], b - a) if b > a else np.zeros(0, _U) for words in hashes)


def size_of(shingles: Shingles) -> int:
    """How many shingles; two that share one hash don't share the other."""
    return max(map(len, shingles))


def linked(s: Shingles, t: Shingles) -> bool:
    """Whether the sets are near-duplicates under both hashes."""
    for x, y in zip(s, t, strict=True):
        if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
            return False
        n = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * n < PERCENT * (len(x) + len(y) - n):
            return False
    return True


def fingerprint(shingles: Shingles) -> bytes:
    return hashlib.blake2b(b"".join(x.tobytes() for x in shingles), digest_size=16).digest()


def prefix_buckets(shingles: np.ndarray) -> np.ndarray:
    """Keys of the smallest shingles, one of which any linked set has among its own smallest; none for large sets."""
    n = len(shingles)
    return mix(shingles[: n + PERCENT * n // -100 + 1] ^ _U(0x8EBC6AF09C88C6E3)) if n <= SMALL else np.zeros(0, _U)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation MinHash of non-empty sets, densified; sets x BINS."""
    sizes = np.array([len(s) for s in sets])
    shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    bins = (shingles >> _U(57)).astype(np.int64)
    cell = owner * BINS + bins
    least = np.r_[True, cell[1:] != cell[:-1]]  # sets are sorted, so a bin's first is its smallest
    raw = np.zeros(len(sets) * BINS, _U)
    filled = np.zeros(len(sets) * BINS, bool)
    raw[cell[least]], filled[cell[least]] = shingles[least], True
    raw, filled = raw.reshape(-1, BINS), filled.reshape(-1, BINS)
    out, rows, cols = raw.copy(), *np.nonzero(~filled)
    attempt = 0
    while len(rows):
        attempt += 1
        probe = (mix(np.arange(BINS, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(attempt * 0xD1342543DE82EF95 % (1 << 64))) >> _U(57)).astype(np.int64)
        hit = filled[rows, probe[cols]]
        out[rows[hit], cols[hit]] = raw[rows[hit], probe[cols[hit]]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands; sets x BANDS."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.arange(BANDS, dtype=_U)[None] * _U(0xE7037ED1A0B428DB) + _U(1)
    for r in range(ROWS):
        out = mix(out ^ rows[:, :, r])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alphabet = spaced()
    for batch in batches:
        for part in slices(batch, 1):
            sets = list(shingle_sets(part, 1, alphabet))
            sizes = np.array([size_of(s) for s in sets])
            some = np.flatnonzero(sizes)
            print_, band, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if len(some):
                signature = signatures([sets[i][0] for i in some])
                keys, low = buckets(signature), (mix(signature) >> _U(56)).astype(np.uint8)
                for k, i in enumerate(some.tolist()):
                    print_[i], sketch[i] = fingerprint(sets[i]), low[k].tobytes() + short_form(sets[i][0])
                    band[i] = np.concatenate([keys[k], prefix_buckets(sets[i][0])]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(print_, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "node", "bands", "sketch"])


def short_form(shingles: np.ndarray) -> bytes:
    """Half of each hash of a short set: two such sets have at least as many in common as the sets themselves."""
    return np.unique((shingles >> _U(32)).astype("<u4")).tobytes() if len(shingles) < SHORT else b""


class Sketches:
    """Sizes and sketches of the members of a block."""

    def __init__(self, sizes: list[int], sketch: list[bytes]):
        self.sizes = np.array(sizes)
        self.bins = np.frombuffer(b"".join(x[:BINS] for x in sketch), np.uint8).reshape(-1, BINS)
        self.short = [np.frombuffer(x, "<u4", offset=BINS) for x in sketch]

    def likely(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Those of ``rest`` that sizes and sketches let be linked with ``x``, the likeliest first."""
        n = self.sizes[x]
        rest = rest[100 * np.minimum(self.sizes[rest], n) >= PERCENT * np.maximum(self.sizes[rest], n)]
        alike = (self.bins[rest] == self.bins[x]).sum(1)
        fits = alike >= SKETCH_LEAST
        few = np.flatnonzero(np.minimum(self.sizes[rest], n) < SKETCHED)
        if len(few):
            theirs = [self.short[y] for y in rest[few].tolist()]
            owner = np.repeat(np.arange(len(few)), [len(t) for t in theirs])
            common = np.bincount(owner[np.isin(np.concatenate(theirs), self.short[x])], minlength=len(few))
            fits[few] = 100 * common >= PERCENT * (n + self.sizes[rest[few]] - common)
        return rest[fits][np.argsort(-alike[fits], kind="stable")]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _link_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members with their centre, which comes first in its block: columns centre, k, id, node, text."""
    alphabet = spaced()
    key, middle = None, None
    for batch in batches:
        found = []
        for part in slices(batch, 4):
            rows = zip(*(part.column(c).to_pylist() for c in range(4)), shingle_sets(part, 4, alphabet), strict=True)
            for centre, k, id_, node, shingles in rows:
                if (centre, k) != key:
                    key, middle = (centre, k), None
                if fingerprint(shingles) != node:  # another row with the same id
                    continue
                if id_ == centre:
                    middle = shingles
                elif middle is not None and linked(middle, shingles):
                    found.append((centre, id_))
        yield _pairs(found)


def _open_pairs(part: np.ndarray, side: np.ndarray, crossing: bool, x: int) -> np.ndarray:
    """Members after ``x`` in other parts; on the other side, if crossing."""
    rest = np.flatnonzero(part[x + 1 :] != part[x]) + x + 1
    return rest[side[rest] != side[x]] if crossing else rest


def _links_of_block(parts: list[int], sets: list[Shingles], sketches: Sketches, side: np.ndarray, crossing: bool) -> list[tuple[int, int]]:
    """Pairs of parts that a link joins; only across the sides, if crossing. Likely pairs are compared first."""
    names, part = np.unique(np.array(parts), return_inverse=True)
    own, out = names[part], []
    for x in range(len(sets) - 1):
        for y in sketches.likely(x, _open_pairs(part, side, crossing, x)).tolist():
            if part[y] != part[x] and linked(sets[x], sets[y]):
                out.append((int(own[x]), int(own[y])))
                part[part == part[y]] = part[x]
    return out


def _find_likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with a likely partner in another part, of blocks that come one after another: columns centre, i, j, side, part, id, n_shingles, sketch."""
    key, held = None, []

    def close() -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        side, part, ids, sizes, sketch = zip(*held, strict=True)
        side, part, sketches = np.array(side), np.array(part), Sketches(sizes, sketch)
        wanted = np.zeros(len(ids), bool)
        for x in range(len(ids) - 1):
            near = sketches.likely(x, _open_pairs(part, side, key[1] != key[2], x))
            if len(near):
                wanted[x] = wanted[near] = True
        return [(key[0], ids[i]) for i in np.flatnonzero(wanted).tolist()]

    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                found += close()
                key, held = row[:3], []
            held.append(row[3:])
        yield _pairs(found)
    yield _pairs(close())


def _link_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between parts, of blocks that come one after another: columns centre, i, j, side, part, node, sketch, text."""
    alphabet = spaced()
    key, parts, sets, sketches, side = None, [], [], [], []

    def close() -> list[tuple[int, int]]:
        if len(parts) < 2:
            return []
        return _links_of_block(parts, sets, Sketches([size_of(s) for s in sets], sketches), np.array(side), key[1] != key[2])

    for batch in batches:
        found = []
        for part in slices(batch, 7):
            rows = zip(*(part.column(c).to_pylist() for c in range(7)), shingle_sets(part, 7, alphabet), strict=True)
            for centre, i, j, of, name, node, sketch, shingles in rows:
                if (centre, i, j) != key:
                    found += close()
                    key, parts, sets, sketches, side = (centre, i, j), [], [], [], []
                if fingerprint(shingles) == node:  # else another row with the same id
                    parts.append(name)
                    sets.append(shingles)
                    sketches.append(sketch)
                    side.append(of)
        yield _pairs(found)
    yield _pairs(close())


def star_members(nodes: DataFrame) -> DataFrame:
    """Distinct ``centre, id`` of all buckets with two or more nodes; a centre is a member of its own star.

    Bucket sizes and centres are written before they are joined back, so that both
    sides of each join are plain exchanges and a hot bucket can be split.
    """
    rows = nodes.select("id", F.explode("bands").alias("bucket"))
    sizes = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    held = materialise(rows.join(sizes, "bucket"), "buckets")
    mates = materialise(held.groupBy("id").agg(F.sum("size").alias("mates")), "mates")
    centres = materialise(held.join(mates, "id").groupBy("bucket").agg(F.max(F.struct("mates", (-F.col("id")).alias("minus"))).alias("_c")).select("bucket", (-F.col("_c.minus")).alias("centre")), "centres")
    out = materialise(held.select("bucket", "id").join(centres, "bucket").select("centre", "id").distinct(), "stars")
    for done in (sizes, held, mates, centres):
        discard(done)
    return out


def _blocks(which: str = "true") -> Column:
    """How many blocks the rows that fulfil a condition need; 0 without rows."""
    return F.expr(f"cast(ceil(greatest(count_if({which}) / {BLOCK_ROWS}, coalesce(sum(if({which}, n_shingles, 0)), 0) / {BLOCK_SHINGLES})) as int)")


def centre_links(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` of centres with members of their stars."""
    blocks = materialise(stars.groupBy("centre").agg(_blocks().alias("n")), "blocks")
    at = F.expr("if(id = centre, sequence(0, n - 1), array(cast(pmod(xxhash64(id), n) as int)))")
    dealt = stars.join(blocks, "centre").select("centre", F.explode(at).alias("k"), "id", "node")
    full = dealt.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("centre", "k", "id", "node", "text")
    sorted_ = full.repartition("centre", "k").sortWithinPartitions("centre", "k", F.expr("id <> centre"), "id")
    out = materialise(map_arrow(sorted_, _link_centres, "a bigint, b bigint"), "links")
    discard(blocks)
    return out


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Members by ``centre, i, j, side`` and the given columns, so that members in different parts of a star meet.

    Far members, which are not in the centre's part, are cut into blocks of their
    own and meet each other (block i with block j) and the near ones (blocks
    counted on after the far ones).
    """
    counts = rows.groupBy("centre").agg(_blocks("far").alias("nf"), _blocks("not far").alias("nn"), F.count(F.lit(1)).alias("n"))
    open_ = materialise(counts.where("nf > 0 and n > 1").select("centre", "nf", "nn"), "open")
    placed = rows.join(open_, "centre").withColumn("k", F.expr("cast(if(far, pmod(xxhash64(id), nf), pmod(xxhash64(id), nn)) as int)"))
    among = "transform(sequence(0, nf - 1), x -> struct(least(x, k) as i, greatest(x, k) as j, if(x < k, 1, 0) as side))"
    over = "if(nn = 0, array(), transform(sequence(nf, nf + nn - 1), x -> struct(k as i, x as j, 0 as side)))"
    under = "transform(sequence(0, nf - 1), x -> struct(x as i, nf + k as j, 1 as side))"
    return placed.select("centre", F.explode(F.expr(f"if(far, concat({among}, {over}), {under})")).alias("g"), *columns).select("centre", "g.*", *columns)


def part_links(stars: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` between parts of a star that ``labels(id, component)`` leave apart; parts are named by their component.

    Sketches meet first; texts only of members that have a likely partner.
    """
    part = stars.where("id <> centre").join(labels, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    mid = part.join(labels.select(F.col("id").alias("centre"), "component"), "centre", "left")
    rows = materialise(mid.select("centre", "id", "node", "n_shingles", "part", (F.col("part") != F.coalesce("component", "centre")).alias("far")), "parts")
    order = ("centre", "i", "j")
    met = _dealt(rows, "part", "id", "node", "n_shingles").join(nodes.select("id", "node", "sketch"), ["id", "node"]).select(*order, "side", "part", "id", "n_shingles", "sketch")
    likely = materialise(map_arrow(met.repartition(*order).sortWithinPartitions(*order, "part"), _find_likely, "a bigint, b bigint").select(F.col("a").alias("centre"), F.col("b").alias("id")).distinct(), "likely")
    kept = materialise(rows.join(likely, ["centre", "id"]), "likely")
    dealt = _dealt(kept, "part", "id", "node").join(nodes.select("id", "node", "sketch"), ["id", "node"])
    full = dealt.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select(*order, "side", "part", "node", "sketch", "text")
    out = materialise(map_arrow(full.repartition(*order).sortWithinPartitions(*order, "part"), _link_parts, "a bigint, b bigint"), "links")
    for done in (rows, likely, kept):
        discard(done)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of near-duplicates of each document.

    Two documents are linked when their shingle sets' similarity is 0.75 or more
    (100 * intersection >= 75 * union). Returns one row per input row: ``doc_id,
    n_shingles, component_id, kept``. Ids are integers; others are an error.
    Null, empty and blank texts have an empty
    set and link with nothing; a null id links with nothing, has a null
    component and is kept; rows that repeat an id are one document. Ties go to
    the smallest id. Very long texts are whole sets like others; a batch holds
    one at least. Other columns are ignored; an empty table gives an empty
    result. Links are confirmed on the full sets under two 64-bit hashes.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {docs.schema[id_col].dataType.simpleString()}")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(map_arrow(texts, _sign, "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>, sketch binary"), "signed")
    usable = signed.where("node is not null and doc_id is not null")
    first = materialise(usable.groupBy("node").agg(F.min("doc_id").alias("id")), "first")  # so that both sides of its joins are plain exchanges and a hot node can be split
    members = materialise(signed.select("doc_id", "n_shingles", "node").join(first, "node", "left").select("doc_id", "n_shingles", "id"), "members")
    nodes = materialise(usable.join(first.select("node", F.col("id").alias("doc_id")), ["node", "doc_id"]).select(F.col("doc_id").alias("id"), "node", "n_shingles", "bands", "sketch").dropDuplicates(["id", "node"]), "nodes")
    discard(signed)
    discard(first)
    pairs = star_members(nodes)
    stars = materialise(pairs.join(nodes.select("id", "node", "n_shingles"), "id"), "stars")
    discard(pairs)
    found = centre_links(stars, texts)
    labels = components(found)
    discard(found)
    found = part_links(stars, labels, nodes, texts)
    joins = components(found).select(F.col("id").alias("part"), F.col("component").alias("whole"))
    for done in (found, stars, nodes):
        discard(done)
    placed = members.join(labels, "id", "left").withColumn("part", F.coalesce("component", "id")).join(joins, "part", "left")
    joined = placed.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("whole", "part", "doc_id")))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id, with all columns, whatever their names.

    Rows without an id, and texts without words, stay; rows that repeat the id
    that stays all stay. An empty table gives an empty result.
    """
    (name,) = unused(docs, "_dropped")
    dropped = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == F.col(name), "left_anti")
