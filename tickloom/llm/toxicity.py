"""Toxicity by nearest labelled examples under TF-IDF cosine, weighted by class evidence.

Terms are all words and word beginnings of the labelled examples, as 64-bit
hashes of their bytes, with document frequencies over all documents. A term's weight is its idf times a factor that
grows with how unevenly the two classes use it (``BASE`` without evidence), as
rare words that say nothing would outweigh the others. The examples are held in
a block-max inverted index: blocks whose largest weights can't add up to the k-th
cosine found are skipped, so a query's neighbours are exact. Their
distance-weighted vote is calibrated on the examples themselves, each left out in
turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended, map_arrow, materialise, without
from .words import alphanumeric, slices, text_view, word_hashes

#: Bytes of the word beginnings that are terms too, as compounds and inflected forms share them.
PREFIXES = (5, 7)
#: Examples of a block; queries scored at once; a term that at least one in ``COMMON`` examples has is held as a dense row.
BLOCK, QUERIES, COMMON = 64, 128, 32
#: Terms are looked up by as many leading bits of their hash.
TOP_BITS = 21
#: Factor of a term that the classes use alike; evidence of ``SURE`` deviations adds 1.
BASE, DOUBT, SURE = 0.1, 2.0, 8.0
Vector = tuple[np.ndarray, np.ndarray]


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All terms of all texts, and the text of each: words and, of longer words, beginnings."""
    *keys, first = word_hashes(*text_view(column), alphanumeric(), 0, *((n, n) for n in PREFIXES))
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    longer = [k != 0 for k in keys]
    return np.concatenate([k[x] for k, x in zip(keys, longer, strict=True)]), np.concatenate([owner[x] for x in longer])


class Vectoriser:
    """Sparse unit vectors: a term's weight times the root of its count.

    ``terms`` are sorted. Terms that no example has count in a vector's length
    only, with the weight ``other``.
    """

    def __init__(self, terms: np.ndarray, weight: np.ndarray, other: float):
        self.terms, self.weight, self.other = terms, weight, other
        self._start = np.searchsorted(terms, np.arange(1 << TOP_BITS, dtype=np.uint64) << np.uint64(64 - TOP_BITS)).astype(np.int32)
        self._start = np.r_[self._start, np.int32(len(terms))]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for others: those with the same top bits are tried one after another."""
        top = (keys >> np.uint64(64 - TOP_BITS)).astype(np.int64)
        at, end = self._start[top], self._start[top + 1]
        out = np.full(len(keys), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.terms[at[live]] == keys[live]
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, number and count of each known term that a text has, in this order, and how many others each text has."""
        keys, owner = text_terms(column)
        at = self.find(keys)
        known = at >= 0
        cells, n = np.unique(owner[known] * len(self.terms) + at[known], return_counts=True)
        return *np.divmod(cells, max(1, len(self.terms))), n, np.bincount(owner[~known], minlength=len(column))

    def __call__(self, column: pa.Array) -> list[Vector]:
        owner, cols, n, others = self.counts(column)
        values = self.weight[cols] * np.sqrt(n)
        length = np.sqrt(np.bincount(owner, values * values, len(column)) + self.other**2 * others)
        values = (values / np.maximum(length, 1e-12)[owner]).astype(np.float32)
        first = np.searchsorted(owner, np.arange(len(column) + 1)).tolist()
        return [(cols[a:b], values[a:b]) for a, b in zip(first, first[1:], strict=False)]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


@dataclass
class BlockMaxIndex:
    """Weights of the examples by term, in blocks of ``BLOCK`` examples with each term's largest weight in each.

    A term's entries ``first[t]`` to ``first[t + 1]`` are the blocks that have it:
    ``block``, its largest weight ``most`` there, and the postings from
    ``posting[e]`` to ``posting[e + 1]``. Terms that many examples have are dense
    rows instead (``row`` is a term's, or -1). Alike examples are neighbours, so
    that blocks differ in what they bound.
    """

    place: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    posting: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    ids: np.ndarray
    label: np.ndarray

    @classmethod
    def build(cls, vectors: list[Vector], ids: list[int], label: list[int], width: int) -> BlockMaxIndex:
        heaviest = [int(c[v.argmax()]) if len(c) else -1 for c, v in vectors]
        order = sorted(range(len(ids)), key=lambda k: (label[k], heaviest[k], ids[k]))
        n, blocks = len(order), -(-len(order) // BLOCK)
        term = np.concatenate([vectors[k][0] for k in order])
        place = np.repeat(np.arange(n), [len(vectors[k][0]) for k in order])
        weight = np.concatenate([vectors[k][1] for k in order])
        common = np.bincount(term, minlength=width) * COMMON >= n
        row = np.where(common, np.cumsum(common) - 1, -1)
        dense = np.zeros((int(common.sum()), blocks * BLOCK), np.float32)
        often = common[term]
        dense[row[term[often]], place[often]] = weight[often]
        term, place, weight = term[~often], place[~often], weight[~often]
        by_term = np.lexsort((place, term))
        term, place, weight = term[by_term], place[by_term], weight[by_term]
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] // BLOCK != place[:-1] // BLOCK)]) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, new) if len(new) else weight
        return cls(
            place, weight, np.searchsorted(term[new], np.arange(width + 1)), place[new] // BLOCK, most, np.r_[new, len(term)], row, dense,
            np.array([ids[k] for k in order], np.int64), np.array([label[k] for k in order], np.int64),
        )

    def nearest_of(self, queries: list[Vector], k: int, leave_out: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of each query's k nearest examples among those that share a term with it, ties by id."""
        for a in range(0, len(queries), QUERIES):
            some = queries[a : a + QUERIES]
            out = np.full(len(some), -1) if leave_out is None else np.array(leave_out[a : a + QUERIES])
            for score in self._scores(some, k, out)[0]:
                top = np.flatnonzero(score > 0)
                if len(top) > k:
                    top = top[score[top] >= np.partition(score[top], len(top) - k)[len(top) - k]]
                top = top[np.lexsort((self.ids[top], -score[top]))][:k]
                yield top, score[top].astype(np.float32)

    def _scores(self, queries: list[Vector], k: int, leave_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of each query with the examples, and which blocks they are whole in; 0 for the one left out.

        The dense rows' part of all cosines comes first. All weights are positive,
        so the k-th of these parts is at most the k-th cosine, and a block whose
        largest part and postings' maxima together are below it can't hold a nearer
        example: only the postings of the other blocks are added.
        """
        cols, values = (np.concatenate(x) for x in zip(*queries, strict=True))
        of = np.repeat(np.arange(len(queries), dtype=np.int32), [len(c) for c, _ in queries])
        row = self.row[cols]
        common = row >= 0
        dense = np.zeros((len(queries), len(self.dense)), np.float32)
        dense[of[common], row[common]] = values[common]
        score = (dense @ self.dense).astype(np.float64)
        held = np.flatnonzero(leave_out >= 0)
        score[held, leave_out[held]] = 0
        cols, values, of = cols[~common], values[~common], of[~common]
        length = self.first[cols + 1] - self.first[cols]
        entry, of, values = _ranges(self.first[cols], length), np.repeat(of, length), np.repeat(values, length)
        blocks = score.shape[1] // BLOCK
        cell = of * blocks + self.block[entry]
        bound = score.reshape(-1, blocks, BLOCK).max(2) + np.bincount(cell, self.most[entry] * values, len(queries) * blocks).reshape(-1, blocks)
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.zeros(len(queries))
        need = (bound >= least[:, None] - 1e-5) & (bound > 0)
        mine = np.flatnonzero(need.ravel()[cell])
        entry = entry[mine]
        size = self.posting[entry + 1] - self.posting[entry]
        at = _ranges(self.posting[entry], size)
        score.ravel()[:] += np.bincount(self.place[at] + np.repeat(of[mine].astype(np.int64) * score.shape[1], size), self.weight[at] * np.repeat(values[mine], size), score.size)
        score[held, leave_out[held]] = 0
        return score, need

    def nearest(self, query: Vector, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return next(self.nearest_of([query], k, [leave_out]))


@dataclass
class ToxicityModel:
    terms: np.ndarray
    term_weight: np.ndarray
    other: float  # weight of terms that no example has
    index: BlockMaxIndex | None
    weight: np.ndarray  # of a vote, by label: what an example stands for
    calibration: np.ndarray
    prior: float
    k: int

    def features(self, place: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        vote = self.weight[self.index.label[place]] / (1.02 - np.clip(cosine, 0, 1))
        yes = float(vote[self.index.label[place] == 1].sum())
        share = (yes + 0.02 * self.prior) / (float(vote.sum()) + 0.02)
        return np.array([1.0, np.log(share / (1 - share + 1e-9) + 1e-9), float(cosine.mean()) if len(cosine) else 0.0])

    def scores(self, queries: list[Vector]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for place, cosine in self.index.nearest_of(queries, self.k):
            yield float(1 / (1 + np.exp(-np.clip(self.features(place, cosine) @ self.calibration, -30, 30)))), place, cosine


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            keys, owner = text_terms(part.column(1))
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[new])), pa.array(keys[new].view(np.int64))], ["toxic", "term"])


def _document_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many texts each term is; tasks send one partial count of each."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vectoriser(shared.value, np.zeros(0), 0.0)
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                n += np.bincount(known.counts(part.column(0))[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

    found = map_arrow(docs, count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples_per_class: int = 1200, k: int = 12) -> ToxicityModel:
    """Fit on at most ``examples_per_class`` labelled rows of each class, those with the smallest hash of the id.

    ``labels`` has the id and ``toxic``; null labels are left out and an id with
    both counts as toxic; of several texts of one id the smallest counts. Texts
    stay on the executors: the driver gets the examples' terms and one sparse
    vector over them for each example, and long texts are taken whole.
    Without examples of both classes every score is the share of toxic labels.
    """
    truth = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in truth.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    chosen = None
    for label in (0, 1):
        some = truth.where(F.col("toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(examples_per_class)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # one text of each id, so that the sample is bounded and the model depends on the rows alone
    sample = materialise(texts.join(F.broadcast(chosen), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    counts = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, None, np.ones(2), np.zeros(3), prior, k)
    rows = map_arrow(sample.select("toxic", "text"), _term_rows, "toxic int, term bigint")
    n0, n1 = float(counts[0]), float(counts[1])
    used = rows.groupBy("term").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n")).toArrow()
    terms, t1, t = used.column("term").to_numpy().view(np.uint64), used.column("n1").to_numpy(), used.column("n").to_numpy()
    order = np.argsort(terms)
    terms, t1, t = terms[order], t1[order], t[order]
    share = t / (n0 + n1)
    uneven = (t1 / n1 - (t - t1) / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-9)
    factor = BASE + np.clip((np.abs(uneven) - DOUBT) / (SURE - DOUBT), 0, 1)
    total_docs = texts.count()
    term_weight = factor * (np.log((total_docs + 1) / (_document_frequencies(texts.select("text"), terms) + 1)) + 1)
    other = BASE * (float(np.log(total_docs + 1)) + 1)
    vectors, ids, label = [], [], []
    shared = docs.sparkSession.sparkContext.broadcast((terms, term_weight, other))

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_vector = Vectoriser(*shared.value)
        for batch in batches:
            for part in slices(batch, 2):
                found = to_vector(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["id", "toxic", "cols", "vals"])

    found = map_arrow(sample.select(F.col("_id").cast("long"), "toxic", "text"), vectors_of, "id bigint, toxic int, cols array<bigint>, vals array<float>").toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])
    for i, y, c, v in zip(*(found.column(j).to_pylist() for j in range(4)), strict=True):
        vectors.append((np.array(c, np.int64), np.array(v, np.float32)))
        ids.append(i)
        label.append(y)
    index = BlockMaxIndex.build(vectors, ids, label, len(terms))
    weight = np.array([sizes.get(0, 0) / n0, sizes.get(1, 0) / n1])
    model = ToxicityModel(terms, term_weight, other, index, weight / weight.max(), np.zeros(3), prior, k)
    by_id = {i: at for at, i in enumerate(index.ids.tolist())}
    x = np.array([model.features(*near) for near in index.nearest_of(vectors, k, [by_id[i] for i in ids])])
    y, w = np.array(label, float), weight[np.array(label)]
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - 0.01 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(h, g), -3, 3)
    model.calibration = beta
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", evidence: int = 3) -> DataFrame:
    """All columns of ``docs``, ``toxicity`` (0 to 1) and ``evidence``, without a shuffle.

    Evidence is the nearest examples' id, label and cosine, of equal cosines the
    smaller id. Texts that share no term with an example, such as null and empty
    ones, have none. Texts are scored whole; repeated rows alike; an empty table
    gives an empty result. Input columns of these names are replaced.
    """
    new = ("toxicity", "evidence")
    docs = without(docs, new)
    at = docs.columns.index(text_col)
    index = model.index
    plain = (model.terms, model.term_weight, model.other, index and tuple(vars(index).values()), model.weight, model.calibration, model.prior, model.k)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    item = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, term_weight, other, index, *rest = shared.value
        model = ToxicityModel(terms, term_weight, other, index and BlockMaxIndex(*index), *rest)
        to_vector = Vectoriser(terms, term_weight, other)

        def score(texts: pa.Array) -> Iterator[tuple[float, list[dict]]]:
            if model.index is None:
                yield from ((model.prior, []) for _ in range(len(texts)))
                return
            for p, place, cosine in model.scores(to_vector(texts)):
                yield p, [{"doc_id": int(model.index.ids[i]), "toxic": int(model.index.label[i]), "cosine": float(c)} for i, c in zip(place[:evidence].tolist(), cosine, strict=False)]

        for batch in batches:
            for part in slices(batch, at):
                found = list(score(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p for p, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(item))], [*part.schema.names, *new])

    schema = extended(docs.schema, "toxicity double, evidence array<struct<doc_id:bigint,toxic:int,cosine:float>>")
    return map_arrow(docs, run, schema)
