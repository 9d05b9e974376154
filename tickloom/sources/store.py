"""The Parquet store of ticks and bars: scans, listings, signatures and writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BARS, TICKS, require
from ..session import shared_dir

#: The hour of a file: of its folder, or of its name.
HOUR_OF_FILE = r"(?:/hour=(\d{1,2})/[^/]*|_(\d{2})h(?:_[^/]*)?\.parquet)$"
PARTS = r"pair=([A-Z]{6})/date=(\d{4}-\d{2}-\d{2})/"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def writers(spark: SparkSession) -> int:
    """How many tasks write partitions: as a fixed number, as adaptive planning would merge small ones and one task would then write all files."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_ticks(spark: SparkSession, root: str, pairs: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Ticks by partition filters on pair and date, with ``file`` and ``row`` as the tie-break of equal instants.

    A store without ticks is an empty frame with the pinned columns.
    """
    if not _exists(spark, f"{root}/ticks"):
        return spark.createDataFrame([], TICKS.plus("date date")).withColumns({"file": F.lit(None).cast("string"), "row": F.lit(None).cast("int")})
    df = spark.read.schema(TICKS.plus("date date, hour int")).parquet(f"{root}/ticks")
    if pairs:
        df = df.where(F.col("pair").isin(*pairs))
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("date") <= F.lit(last).cast("date"))
    return df.withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index").cast("int")}).drop("hour")


def write_ticks(ticks: DataFrame, root: str) -> None:
    """Replace the partitions (pair, date, hour) that ``ticks`` has; other hours of a day stay as they are.

    Rows are dealt by these keys, so that an hour is one file and a hot pair is
    spread over its hours. Attempts of lost tasks leave no files.
    """
    rows = require(ticks.select(*TICKS.names), TICKS).withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    dealt = rows.repartition(writers(ticks.sparkSession), "pair", "date", "hour").sortWithinPartitions("pair", "date", "hour", "ts")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair", "date", "hour").parquet(f"{root}/ticks")


def read_bars(spark: SparkSession, root: str, timeframe: str, pairs: list[str] | None = None) -> DataFrame:
    """Bars of a timeframe; no stored bar is an error."""
    schema = BARS.plus("timeframe string, month string")
    if not _exists(spark, f"{root}/bars"):
        raise FileNotFoundError(f"no bars below {root}")
    df = spark.read.schema(schema).parquet(f"{root}/bars").where(F.col("timeframe") == timeframe)
    if pairs:
        df = df.where(F.col("pair").isin(*pairs))
    if df.isEmpty():
        raise LookupError(f"no {timeframe} bars of {pairs or 'any pair'} below {root}")
    return df.select(*BARS.names)


MONTH = ["timeframe", "pair", "month"]


def write_bars(bars: DataFrame, days: DataFrame, root: str) -> None:
    """Replace the bars of ``days(timeframe, pair, date)`` by ``bars``; a splice by days into files by month.

    A month that has a day among them is written whole: its other days as they
    were stored, first to the shared folder, then in place of the old partition.
    Months that have no bars left are deleted.
    """
    spark = bars.sparkSession
    month = F.date_format("ts", "yyyy-MM")
    rows = bars.withColumn("month", month)
    touched = days.select("timeframe", "pair", F.date_format("date", "yyyy-MM").alias("month")).distinct()
    if _exists(spark, f"{root}/bars"):
        old = spark.read.schema(BARS.plus("timeframe string, month string")).parquet(f"{root}/bars").join(F.broadcast(touched), MONTH, "left_semi")
        old = old.withColumn("date", F.to_date("ts")).join(days, ["timeframe", "pair", "date"], "left_anti").drop("date")
        rows = rows.unionByName(old)
    work = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    rows.write.parquet(work)
    merged = spark.read.schema(rows.schema).parquet(work)
    merged.repartition(writers(spark), *MONTH).sortWithinPartitions(*MONTH, "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(f"{root}/bars")
    for r in touched.join(merged.select(*MONTH).distinct(), MONTH, "left_anti").toLocalIterator():
        delete(spark, f"{root}/bars/timeframe={r['timeframe']}/pair={r['pair']}/month={r['month']}")
    delete(spark, work)


def files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of all Parquet files below a folder; contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root).select("path", "length")


def listing(found: DataFrame) -> DataFrame:
    """``pair, date, hour`` present by the files' folders or names."""
    x = F.regexp_extract
    hour = F.concat(x("path", HOUR_OF_FILE, 1), x("path", HOUR_OF_FILE, 2))
    return found.select(x("path", PARTS, 1).alias("pair"), x("path", PARTS, 2).cast("date").alias("date"), hour.alias("hour")).where("hour <> ''").select("pair", "date", F.col("hour").cast("int").alias("hour")).distinct()


def hours_present(ticks: DataFrame) -> DataFrame:
    """``pair, date, hour`` that have ticks, for stores whose file names don't carry the hour."""
    return ticks.select("pair", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).distinct()


def read_stored_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Manifest rows that ``write_manifest`` wrote, or None before the first."""
    return spark.read.parquet(path).drop("month") if _exists(spark, path) else None


def write_manifest(hours: DataFrame, path: str) -> None:
    """Manifest rows by pair and month; a row replaces the stored one of its hour, others stay.

    The months that ``hours`` touches are merged in the shared folder first and
    then put in place of the old partitions.
    """
    spark = hours.sparkSession
    work = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    hours.withColumn("month", F.date_format("date", "yyyy-MM")).write.parquet(f"{work}/new")
    rows = spark.read.parquet(f"{work}/new")
    if _exists(spark, path):
        old = spark.read.parquet(path).join(F.broadcast(rows.select("pair", "month").distinct()), ["pair", "month"], "left_semi")
        rows = rows.unionByName(old.join(rows.select("pair", "date", "hour"), ["pair", "date", "hour"], "left_anti"), allowMissingColumns=True)
    rows.write.parquet(f"{work}/merged")
    merged = spark.read.parquet(f"{work}/merged").repartition(writers(spark), "pair", "month")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair", "month").parquet(path)
    delete(spark, work)


def signatures(found: DataFrame) -> DataFrame:
    """``pair, date, signature`` where a signature is ``count:bytes`` of the day's files."""
    x = F.regexp_extract
    keyed = found.select(x("path", PARTS, 1).alias("pair"), x("path", PARTS, 2).cast("date").alias("date"), "length").where("pair <> ''")
    return keyed.groupBy("pair", "date").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("length").cast("string")).alias("signature"))


def footprint(found: DataFrame) -> DataFrame:
    """Files, bytes and days by pair."""
    x = F.regexp_extract
    return found.select(x("path", PARTS, 1).alias("pair"), x("path", PARTS, 2).alias("date"), "length").where("pair <> ''").groupBy("pair").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.countDistinct("date").alias("days"))


def compact(spark: SparkSession, root: str, pairs: list[str], first: str, last: str) -> None:
    """Rewrite the days of a range with one file per pair-day instead of one per hour."""
    days = read_ticks(spark, root, pairs, first, last).select(*TICKS.names, "date")
    target = f"{root}/ticks_compact"
    days.repartition("pair", "date").sortWithinPartitions("ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair", "date").parquet(target)
