"""Generated relations: requests, calendars and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import market_open, reaches_feed


def _dates(first: str, last: str) -> Column:
    return F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))


def request_grid(spark: SparkSession, pairs: list[str], first: str, last: str, hours: tuple[int, ...] = tuple(range(24))) -> DataFrame:
    """``pair, date, hour`` for all pairs, days and hours; repeats collapse."""
    grid = spark.createDataFrame([(p,) for p in dict.fromkeys(pairs)], "pair string").select("pair", _dates(first, last).alias("date"))
    return grid.select("pair", "date", F.explode(F.array(*map(F.lit, dict.fromkeys(hours)))).alias("hour"))


def instant(date: str = "date", hour: str = "hour") -> Column:
    return F.timestamp_micros(F.unix_date(F.col(date)).cast("long") * 86_400_000_000 + F.col(hour).cast("long") * 3_600_000_000)


def trading_days(spark: SparkSession, first: str, last: str, hour: int) -> DataFrame:
    """Days whose given hour is inside the trading week."""
    return spark.range(1).select(_dates(first, last).alias("date")).withColumn("hour", F.lit(hour)).where(market_open(instant())).select("date")


def open_hours(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every hour of the range with whether it is open and whether it reaches the feed."""
    grid = spark.range(1).select(_dates(first, last).alias("date")).select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.select("date", "hour", market_open(instant()).alias("open"), reaches_feed(instant()).alias("reaches_feed"))


def expected_hours(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Open hours by year."""
    return open_hours(spark, first, last).where("open").groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("hours"))


def pair_calendar(spark: SparkSession, pairs: list[str], days: DataFrame) -> DataFrame:
    """Every pair on every day; as many pairs as are named."""
    return days.crossJoin(F.broadcast(spark.createDataFrame([(p,) for p in pairs], "pair string"))).select("pair", "date")


def pair_months(spark: SparkSession, ranges: list[tuple[str, str, str]]) -> DataFrame:
    """Pair-months of ``(pair, first, last)``, newest first, clipped to the range."""
    r = spark.createDataFrame(ranges, "pair string, first string, last string").select("pair", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"))
    months = r.select("*", F.explode(F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.select("pair", F.year("m").alias("year"), F.month("m").alias("month"), F.greatest("first", "m").alias("first"), F.least("last", F.last_day("m")).alias("last")).orderBy(F.desc("year"), F.desc("month"), "pair")


def probe_plan(spark: SparkSession, pairs: list[str], days: DataFrame, hour: int, done: DataFrame | None = None) -> DataFrame:
    """Probes by day and then pair, less those that are done."""
    plan = pair_calendar(spark, pairs, days).withColumn("hour", F.lit(hour))
    if done is not None:
        plan = plan.join(done.select("pair", "date", "hour"), ["pair", "date", "hour"], "left_anti")
    return plan.orderBy("date", "pair")
