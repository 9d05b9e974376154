"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed byte trigrams
predicts each bit; the codeword with the least weighted loss wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended, map_arrow, unused, without
from .words import slices, text_view

UNKNOWN = "und"
FEATURES = 1 << 13
_LETTER = regex.compile(r"\p{L}")
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class LanguageModel:
    """Codewords, the classifiers' weights and the weight of each bit's loss."""

    langs: tuple[str, ...]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray
    ambiguous_below: float = 0.2


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed byte-trigram counts of each text; bytes that aren't letters count as spaces."""
    base = int(offsets[0])
    clean = _CLEAN[data[base : int(offsets[-1])]].astype(np.uint32)
    keys = clean[:-2] * np.uint32(0x9E3779B1) + clean[1:-1] * np.uint32(0x85EBCA77) + clean[2:] * np.uint32(0xC2B2AE3D) if len(clean) > 2 else np.zeros(0, np.uint32)
    keys = (keys ^ (keys >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)
    for a, b in zip(offsets[:-1] - base, offsets[1:] - base, strict=True):
        yield np.bincount(keys[a : max(a, b - 2)], minlength=FEATURES)


def _normalise(x: np.ndarray) -> np.ndarray:
    """Rows of counts as unit vectors of their roots, in place."""
    np.sqrt(x, out=x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    return x


def codewords(k: int) -> np.ndarray:
    """All bipartitions for up to 6 languages, else the best of some seeded random codes."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        sets = [s for r in range(k) for s in combinations(range(1, k), r)][:-1]
        return np.array([[1 if i == 0 or i in s else -1 for s in sets] for i in range(k)], float)
    rng, best, bits = np.random.default_rng(9), None, 6 * int(np.ceil(np.log2(k))) + 9
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, bits))
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i)) if k < 200 else 0
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def _collect_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            index, value = [], []
            for row in trigram_counts(*text_view(part.column(1))):
                index.append(np.flatnonzero(row).astype(np.int32))
                value.append(row[index[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.int32()))], ["lang", "o", "index", "value"])


def fit_language_model(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 2400, steps: int = 120) -> LanguageModel:
    """Fit on about ``max_rows`` rows, equally many of each language as far as there are, by the hash of id and text.

    Each row reaches the driver as at most ``FEATURES`` counts, however long its
    text, so the driver holds at most some 100 MB. Rows that repeat an id and its
    text count once, so the model depends on the rows alone. Rows with a null
    text or language are left out; without rows the model has no languages and
    every prediction is ``und``.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return LanguageModel((), np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1), np.ones(1))
    share, per_lang = F.lit(0.0), max_rows / len(langs)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.1 * per_lang / n))).otherwise(share)
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    few = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("o"), share.alias("s")).where(F.pmod("o", F.lit(1 << 30)) / float(1 << 30) < F.col("s"))
    once = few.groupBy("lang", "o").agg(F.min("text").alias("text")).select("lang", "text", "o")
    found = map_arrow(once, _collect_counts, "lang string, o bigint, index array<int>, value array<int>").orderBy("o", "lang").limit(2 * max_rows + 100).toArrow()
    found = found.sort_by([("lang", "ascending"), ("o", "ascending")])  # the order in which tasks end doesn't matter
    names, index, value = (found.column(c).to_pylist() for c in ("lang", "index", "value"))
    x = np.zeros((len(names), FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(index, value, strict=True)):
        x[i, a] = b
    x = _normalise(x)
    y = np.array([langs.index(n) for n in names])
    code = codewords(len(langs))
    if len(langs) == 1:
        return LanguageModel(langs, code, np.zeros((FEATURES, 1), np.float32), np.ones(1), np.ones(1))
    target = code[y]
    per_class = np.bincount(y, minlength=len(langs))
    weight = (1 / np.maximum(per_class, 1))[y][:, None]
    weight = (weight / weight.sum()).astype(np.float32)
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):  # logistic regression by gradient descent with momentum
        margin = np.clip(target * (x @ w + b), -30, 30)
        g = (-target * weight / (1 + np.exp(margin))).astype(np.float32)
        vw = 0.9 * vw - 4.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 4.0 * g.sum(0)
        w, b = w + vw, b + vb
    margin = target * (x @ w + b)
    error = ((margin < 0) * weight).sum(0) + 0.5 / len(names)
    return LanguageModel(langs, code, w, b, np.log((1 - error) / error).clip(0.1) / np.log(2 * len(names)))


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword under the weighted logistic loss, its share, and whether the next one is close."""
    loss = (np.log1p(np.exp(-np.clip(margins[:, None, :] * model.code[None], -30, 30))) * model.trust).sum(2)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    top = np.sort(share, axis=1)
    close = top[:, -1] - top[:, -2] < model.ambiguous_below if share.shape[1] > 1 else np.zeros(len(share), bool)
    return best, share[np.arange(len(share)), best], close


def _predict(model: LanguageModel, part: pa.RecordBatch, text: int) -> tuple[list, np.ndarray, np.ndarray]:
    column = part.column(text)
    langs, score, close = [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
    known = np.array([bool(t) and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
    if model.langs and known.any():
        x = _normalise(np.array([row for row, k in zip(trigram_counts(*text_view(column)), known, strict=True) if k], np.float32))
        best, share, near = decode(model, x @ model.weights + model.bias)
        score[known], close[known] = share, near
        for i, k in zip(np.flatnonzero(known), best, strict=True):
            langs[i] = model.langs[k]
    return langs, score, close


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", new: tuple[str, ...] = ("lang_pred", "lang_score", "lang_ambiguous")) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, lang_score, lang_ambiguous``, without a shuffle.

    A null, empty or letterless text gives ``und`` with score 0. An input column
    with one of the new names is replaced. Order and repeats of rows don't matter;
    a text is judged whole, however long. Of codewords that are equally near, the
    language that sorts first wins. An empty table gives an empty result.
    """
    docs = without(docs, new)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                langs, score, close = _predict(shared.value, part, at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(close)], [*part.schema.names, *new])

    return map_arrow(docs, run, extended(docs.schema, f"{new[0]} string, {new[1]} double, {new[2]} boolean"))


def known_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose text has a language at all, with ``lang_col`` set to the predicted one.

    Texts that are null or have no letter go. Where the prediction is flagged as
    ambiguous, a language that the row has already stays. A model without
    languages judges by letters alone and leaves ``lang_col`` as it is, as it is
    left out where the column is missing. All other columns come through.
    """
    if not model.langs:
        return docs.where(F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    names = unused(docs, "lang_pred", "lang_score", "lang_ambiguous")
    found = identify(docs, model, text_col, names).where(F.col(names[0]) != UNKNOWN)
    lang = F.when(F.col(names[2]), F.coalesce(F.col(f"`{lang_col}`"), names[0])).otherwise(F.col(names[0])) if lang_col in docs.columns else None
    return found.select(*[lang.alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
