"""Exact deduplication by content hash, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WHITE


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose normalised texts are equal.

    The text is grouped under its 128-bit hash *and* its bytes, so that texts
    which only share the hash stay apart. Rows are pre-aggregated before the
    shuffle: a group of any size costs one row per task. Only groups of two or
    more are joined back, on the hashes and without texts, and the join is plain
    on both sides so that a hot group can be split.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Null texts are empty texts. A null id never outranks another;
    a group of null ids alone has a null keep_id and all its rows are kept.
    Repeated rows with the same id and text count in group_size and share their
    verdict. Texts are compared whole, however long. Other columns are ignored; an
    empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_norm"))
    keyed = base.withColumn("_h", F.unhex(F.md5("_norm")))
    variants = keyed.groupBy("_h", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = variants.where("group_size > 1").select("_h", F.unhex(F.sha2("_norm", 256)).alias("_s"), "keep_id", "group_size")
    members = keyed.select("doc_id", "_h", F.unhex(F.sha2("_norm", 256)).alias("_s"))
    return members.join(groups, ["_h", "_s"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group of equal normalised texts, with all its columns.

    One row stays of rows that repeat the smallest id; a row with a null id stays
    only if no row with an id has the text. All columns come through, whatever
    their names; an empty table gives an empty result. Rows are grouped by hash
    and bytes and reduced before the shuffle, so a hot group costs one row per
    task and texts cross the network once.
    """
    order = F.struct(F.col(id_col).isNull(), F.col(id_col))
    rows = docs.select(normalised(F.col(text_col)).alias("_norm"), order.alias("_order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = rows.groupBy(F.md5("_norm").alias("_h"), "_norm").agg(F.min_by("_row", "_order").alias("_row"))
    return kept.select("_row.*")
