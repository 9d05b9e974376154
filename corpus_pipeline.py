"""The corpus pipeline: language, exact and near duplicates, benchmark passages, tokens.

Null, empty and letterless texts go in the first stage, as they have no language.
Rows that repeat an id and its text are exact copies, of which one stays; rows
with a null id are kept by all stages that pick one row of a group only if no row
with an id has the text. Long texts are taken whole. Extra columns come through
all stages, also those that are named like what operators add, except for the
last stage's own. An empty table gives an empty result.

Each stage is written as Parquet to the folder that ``spark.checkpoint.dir``
names, which all executors share, and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm._shared import discard, materialise, table, trainable
from tickloom.llm.bpe import bpe_encode
from tickloom.llm.decontam import decontaminate
from tickloom.llm.exact import exact_dedup
from tickloom.llm.langid import fit_language_model, known_language
from tickloom.llm.near import near_dedup
from tickloom.llm.queries import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, and writes the predicted one into ``lang``.

    Where the prediction is ambiguous, a language that the document has stays. If
    no document has a language to learn from, only letters are asked for.
    """
    return known_language(docs, fit_language_model(docs.where(trainable(F.col("doc_id")))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of equal texts, that with the smallest id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id."""
    return near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark; an empty benchmark drops none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of their decoded text, in place of the text."""
    return bpe_encode(docs, vocabulary_path(), keep=[c for c in docs.columns if c != "text"]).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("bpe", tokens),
]

#: SQL cannot express the language classifier; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, last = materialise(stage(spark, docs, sf_dir), name), docs
        if before is not None:
            discard(last)
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
