"""One row per requested hour, and what follows from them: coverage, outliers, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import SESSIONS, market_open, session_label
from ..functions.pairs import pip_size

KEY = ["pair", "date", "hour"]
STATUSES = ("ok", "empty", "closed", "gap")
WHOLE_DAY_HOURS, LEAST_DAYS, LOW, HIGH = 20, 3, 0.25, 4.0


def hour_instant() -> Column:
    return F.col("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("hour"))


def manifest(requests: DataFrame, hours: DataFrame) -> DataFrame:
    """Every requested hour exactly once, with a status.

    ``hours`` has ``pair, date, hour``, ``ticks``, ``duplicates`` and
    ``rejected`` (whether a hard reason or a failed fetch or decode came up) for
    the hours that answered. Rejected hours are gaps and write no ticks;
    unanswered ones are closed outside the trading week and empty inside it.
    """
    m = requests.select(*KEY).distinct().join(hours, KEY, "left")
    open_ = market_open(hour_instant())
    status = F.when(F.coalesce("rejected", F.lit(False)), "gap").when(F.coalesce("ticks", F.lit(0)) > 0, "ok").when(open_, "empty").otherwise("closed")
    return m.select(
        *KEY,
        status.alias("status"),
        F.coalesce("ticks", F.lit(0)).cast("long").alias("decoded_ticks"),
        F.when(status == "ok", F.col("ticks")).otherwise(F.lit(0)).cast("long").alias("written_ticks"),
        F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates_dropped"),
        (status == "empty").alias("empty_trading_hour"),
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same hour."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    others = [c for c in old.columns if c not in KEY]
    return both.groupBy(*KEY).agg(F.max_by(F.struct(*others), "_turn").alias("_r")).select(*KEY, "_r.*").select(*old.columns)


def pending(requests: DataFrame, settled: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests still to be made: not settled, or settled as ok without a stored file."""
    done = settled.where(F.col("status").isin("empty", "closed")).select(*KEY).unionByName(settled.where("status = 'ok'").select(*KEY).join(stored.select(*KEY), KEY, "left_semi"))
    return requests.join(done, KEY, "left_anti")


def coverage_by_day(hours: DataFrame) -> DataFrame:
    """Requested, ok, empty and gap hours, ticks and duplicates of each pair-day."""
    s = F.col("status")
    return hours.groupBy("pair", "date").agg(
        F.count(F.lit(1)).alias("hours_requested"),
        F.count_if(s == "ok").alias("hours_ok"),
        F.count_if(s.isin("empty", "closed")).alias("hours_empty"),
        F.count_if(~s.isin("ok", "empty", "closed")).alias("hours_gap"),
        F.sum("written_ticks").alias("ticks"),
        F.sum("duplicates_dropped").alias("duplicates_dropped"),
    )


def tick_count_outliers(days: DataFrame, whole_day_hours: int = WHOLE_DAY_HOURS, least_days: int = LEAST_DAYS) -> DataFrame:
    """Days with ``whole_trading_day``, the trailing median of earlier whole days, and whether the count is far off it."""
    whole = F.col("hours_ok") >= whole_day_hours
    before = Window.partitionBy("pair").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    past = F.when(whole & (F.col("ticks") > 0), F.col("ticks"))
    median, n = F.percentile(past, F.lit(0.5)).over(before), F.count(past).over(before)
    judged = days.withColumns({"whole_trading_day": whole, "trailing_median": F.when(n >= least_days, median)})
    far = (F.col("ticks") < LOW * F.col("trailing_median")) | (F.col("ticks") > HIGH * F.col("trailing_median"))
    return judged.withColumn("tick_count_outlier", F.coalesce(F.col("whole_trading_day") & (F.col("trailing_median") > 0) & far, F.lit(False)))


def coverage_summary(hours: DataFrame) -> DataFrame:
    """A row per status, every status present."""
    spark = hours.sparkSession
    got = hours.groupBy("status").agg(F.count(F.lit(1)).alias("hours"), F.sum("written_ticks").alias("ticks"), F.sum("duplicates_dropped").alias("duplicates_dropped"))
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(got, "status", "left").na.fill(0)


def totals(hours: DataFrame) -> DataFrame:
    """Rollup by pair and year; null pair or year stands for all."""
    s = F.col("status")
    return hours.withColumn("year", F.year("date")).rollup("pair", "year").agg(
        F.count(F.lit(1)).alias("hours"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "gap").alias("gaps"), F.count_if("empty_trading_hour").alias("warnings"), F.sum("written_ticks").alias("ticks"), F.countDistinct("date").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def gap_list(hours: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` gaps by pair, date and hour, each with the true number of gaps."""
    gaps = hours.where("status = 'gap'").select(*KEY)
    return gaps.orderBy(*KEY).limit(most).crossJoin(gaps.agg(F.count(F.lit(1)).alias("gaps")))


def spread_by_session(ticks: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99, 0.999)) -> DataFrame:
    """Spread in pips by pair and session and, as session ``all``, by pair."""
    pips = ticks.select("pair", session_label(F.col("ts")).alias("session"), ((F.col("ask") - F.col("bid")) / pip_size(F.col("pair"))).alias("pips"))
    wide = pips.groupingSets([["pair", "session"], ["pair"]], "pair", "session").agg(F.count(F.lit(1)).alias("ticks"), F.percentile("pips", F.array(*map(F.lit, percentiles))).alias("_p"), F.avg("pips").alias("mean"), F.max("pips").alias("max"), F.grouping("session").alias("_g"))
    names = [f"p{100 * p:g}".replace(".", "_") for p in percentiles]
    return wide.select("pair", F.when(F.col("_g") == 1, "all").otherwise(F.col("session")).alias("session"), "ticks", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)], "mean", "max")


def session_spread(ticks: DataFrame) -> DataFrame:
    """Spread by session over all pairs, every session present, values rounded to six places."""
    spark = ticks.sparkSession
    pips = ticks.select(session_label(F.col("ts")).alias("session"), ((F.col("ask") - F.col("bid")) / pip_size(F.col("pair"))).alias("pips"))
    got = pips.groupBy("session").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.avg("pips"), 6).alias("mean"), F.percentile("pips", F.array(*map(F.lit, (0.5, 0.9, 0.99, 0.999)))).alias("_p"))
    every = spark.createDataFrame([(s,) for s in SESSIONS], "session string")
    out = every.join(got, "session", "left")
    return out.select("session", F.coalesce("ticks", F.lit(0)).alias("ticks"), "mean", *[F.round(F.get("_p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p90", "p99", "p99_9"))])


def hourly_profile(ticks: DataFrame) -> DataFrame:
    """Ticks by hour of the day, all 24 hours present."""
    every = ticks.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    got = ticks.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("ticks"))
    return every.join(got, "hour", "left").na.fill(0)


# Month and day of the holidays on which all markets are shut.
MAJOR_HOLIDAYS = ((1, 1), (12, 25))


def holiday_calendar(hours: DataFrame, most_ok: int = 0, fixed: tuple[tuple[int, int], ...] = MAJOR_HOLIDAYS) -> DataFrame:
    """``date, observed, listed``: days that ``holidays`` finds, and fixed holidays within the dates of ``hours``."""
    days = hours.select("date").distinct()
    known = F.lit(False)
    for month, day in fixed:
        known = known | ((F.month("date") == month) & (F.dayofmonth("date") == day))
    found = holidays(hours, most_ok).withColumn("observed", F.lit(True))
    return days.withColumn("listed", known).join(found, "date", "left").select("date", F.coalesce("observed", F.lit(False)).alias("observed"), "listed").where("observed or listed")


def holidays(hours: DataFrame, most_ok: int = 0) -> DataFrame:
    """Weekdays on which no pair had more than ``most_ok`` hours with ticks although the market was open."""
    open_hours = hours.where(market_open(hour_instant()))
    by_pair = open_hours.groupBy("date", "pair").agg(F.count_if(F.col("status") == "ok").alias("ok"))
    return by_pair.groupBy("date").agg(F.max("ok").alias("most")).where(f"most <= {most_ok}").select("date")
