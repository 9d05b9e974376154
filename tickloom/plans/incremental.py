"""Bars that follow the store: only days whose files changed are built again."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import timeframe
from ..operators.bars import bars_of_timeframes
from ..session import shared_dir
from ..sources.store import _exists, delete, files, read_ticks, signatures, write_bars

STATE = "timeframe string, pair string, date date, signature string"


def stale_days(now: DataFrame, state: DataFrame, timeframes: list[str]) -> DataFrame:
    """``timeframe, pair, date`` whose signature is new or differs, and days whose files are gone (``gone``)."""
    wanted = now.select("*", F.explode(F.array(*map(F.lit, timeframes))).alias("timeframe"))
    known = state.where(F.col("timeframe").isin(*timeframes)).withColumnRenamed("signature", "_was")
    both = wanted.join(known, ["timeframe", "pair", "date"], "full")
    return both.where(~F.col("signature").eqNullSafe(F.col("_was"))).select("timeframe", "pair", "date", F.col("signature").isNull().alias("gone"))


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of the state, oldest first; only complete ones count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/bars_state")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(p for p in found if _exists(spark, f"{p}/_SUCCESS"))


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """Signatures of the built days: the newest complete version."""
    found = _versions(spark, root)
    return spark.read.schema(STATE).parquet(found[-1]) if found else spark.createDataFrame([], STATE)


def build_bars(spark: SparkSession, root: str, timeframes: list[str]) -> DataFrame:
    """Bring the stored bars up to date and return the days that were built.

    Stale days are found from the file listing alone. Their ticks are read once by
    a semi join that prunes partitions; coarser bars roll up from the finest. Each
    timeframe gets exactly its own stale days, spliced into files by month, so no
    day is stored twice; days whose files are gone lose their bars. The state is a
    new version beside the old one, written last: a build that stops midway is
    repeated by the next.
    """
    names = [timeframe(t) for t in timeframes]
    work = f"{shared_dir(spark)}/stale-{uuid.uuid4().hex}"
    now = signatures(files(spark, f"{root}/ticks"))
    old = _versions(spark, root)
    stale_days(now, read_state(spark, root), names).write.parquet(work)
    todo = spark.read.parquet(work)
    if todo.isEmpty():
        return todo
    build = todo.where("not gone")
    days = ["timeframe", "pair", "date"]
    ticks = read_ticks(spark, root).join(build.select("pair", "date").distinct(), ["pair", "date"], "left_semi")
    made = bars_of_timeframes(ticks.withColumn("seq", F.col("row")), names, "seq").withColumn("date", F.to_date("ts"))
    write_bars(made.join(build.select(*days), days, "left_semi").drop("date"), todo.select(*days), root)
    new = now.select(F.explode(F.array(*map(F.lit, names))).alias("timeframe"), "pair", "date", "signature")
    keep = read_state(spark, root).where(~F.col("timeframe").isin(*names))
    keep.unionByName(new).write.parquet(f"{root}/bars_state/{time.time_ns()}")
    for path in old:
        delete(spark, path)
    return todo
