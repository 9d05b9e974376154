"""Open, high, low and close bars of two-sided quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, ShortType

from ..functions.calendar import bucket_micros, micros
from ..schemas import QUOTES, STEPS

HOUR = 3_600_000_000


def order_key(offset: Column, seq: Column | None, kind: DataType | None = None) -> Column:
    """One number that orders the ticks of a bucket by time, then by ``seq``, whatever its value.

    A single number keeps the aggregation hash-based; ordering by a struct would
    make Spark sort. A ``seq`` of 32 bits, not negative, and an offset within an
    hour fit a BIGINT. A BIGINT ``seq`` takes a DECIMAL(38), which holds all of
    both at about a third of the speed.
    """
    if seq is None:
        return offset
    if isinstance(kind, IntegerType | ShortType | ByteType):
        return F.shiftleft(offset, 31) + seq
    return (offset.cast("decimal(18,0)") * F.lit(1 << 32).cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + seq.cast("decimal(19,0)")).cast("decimal(38,0)")


def bars(ticks: DataFrame, timeframe: str, seq: str | None = "seq") -> DataFrame:
    """Bars of one timeframe; ``ts`` is the opening instant of [open, open + width).

    Buckets without ticks have no bar. One shuffle by (pair, bucket) after a
    partial aggregation, so a hot pair costs its buckets once per task. Timeframes
    beyond an hour roll up from hours if ``seq`` has 32 bits.
    """
    width, kind = micros(timeframe), ticks.schema[seq].dataType if seq else None
    if width > HOUR and isinstance(kind, IntegerType | ShortType | ByteType):
        return roll_up(bars(ticks, "1h", seq), timeframe)
    at = bucket_micros(F.col("ts"), width)
    q = ticks.select("pair", at.alias("_at"), order_key(F.unix_micros("ts") - at, F.col(seq) if seq else None, kind).alias("_key"), "bid", "ask").withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "_spread": F.col("ask") - F.col("bid")})
    aggs = []
    for name in QUOTES:
        aggs += [F.min_by(name, "_key").alias(f"{name}_open"), F.max(name).alias(f"{name}_high"), F.min(name).alias(f"{name}_low"), F.max_by(name, "_key").alias(f"{name}_close")]
    grouped = q.groupBy("pair", "_at").agg(*aggs, F.count(F.lit(1)).alias("tick_count"), F.avg("_spread").alias("spread_mean"), F.max("_spread").alias("spread_max"))
    return grouped.select("pair", F.timestamp_micros("_at").alias("ts"), *[f"{n}_{s}" for n in QUOTES for s in STEPS], "tick_count", "spread_mean", "spread_max")


def bars_of_timeframes(ticks: DataFrame, timeframes: list[str], seq: str | None = "seq") -> DataFrame:
    """Bars of several timeframes: the finest from ticks, each coarser one from the next finer that divides it.

    The ticks are read and shuffled once; every step shuffles the bars of the step
    before, which are fewer and fewer, and Spark reuses that exchange where two
    steps read it.
    """
    names = sorted(dict.fromkeys(timeframes), key=micros)
    made: dict[str, DataFrame] = {}
    for name in names:
        finer = [n for n in made if micros(name) % micros(n) == 0]
        made[name] = roll_up(made[finer[-1]], name) if finer else bars(ticks, name, seq)
    out = [df.select(F.lit(name).alias("timeframe"), *df.columns) for name, df in made.items()]
    return reduce(DataFrame.unionByName, out)


def roll_up(fine: DataFrame, timeframe: str) -> DataFrame:
    """Exact coarser bars from finer ones: first, highest, lowest, last, sums, and the mean weighted by ticks."""
    at = bucket_micros(F.col("ts"), micros(timeframe))
    keyed = fine.withColumns({"_at": at, "_key": F.unix_micros("ts") - at})
    aggs = []
    for name in QUOTES:
        aggs += [F.min_by(f"{name}_open", "_key").alias(f"{name}_open"), F.max(f"{name}_high").alias(f"{name}_high"), F.min(f"{name}_low").alias(f"{name}_low"), F.max_by(f"{name}_close", "_key").alias(f"{name}_close")]
    total = F.sum("tick_count")
    out = keyed.groupBy("pair", "_at").agg(*aggs, total.alias("tick_count"), (F.sum(F.col("spread_mean") * F.col("tick_count")) / total).alias("spread_mean"), F.max("spread_max").alias("spread_max"))
    return out.select("pair", F.timestamp_micros("_at").alias("ts"), *[f"{n}_{s}" for n in QUOTES for s in STEPS], "tick_count", "spread_mean", "spread_max")


def empty_bins(made: DataFrame, timeframe: str) -> DataFrame:
    """Buckets between a pair's first and last bar that have none."""
    width = micros(timeframe)
    ends = made.groupBy("pair").agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    # One sequence per day of range, so that no row holds a pair's whole history.
    days = ends.select("pair", "lo", "hi", F.explode(F.sequence(F.expr("lo div 86400000000"), F.expr("hi div 86400000000"))).alias("d"))
    lo, hi = F.greatest("lo", F.col("d") * 86_400_000_000), F.least("hi", (F.col("d") + 1) * 86_400_000_000 - width)
    bins = days.where(lo <= hi).select("pair", F.explode(F.sequence(lo, hi, F.lit(width))).alias("us")).select("pair", F.timestamp_micros("us").alias("ts"))
    return bins.join(made.select("pair", "ts"), ["pair", "ts"], "left_anti")


def splice(stored: DataFrame, fresh: DataFrame, stale: DataFrame, keys: tuple[str, ...] = ("pair", "date")) -> DataFrame:
    """Stored bars without the stale days, and the fresh bars of exactly those days.

    Fresh bars of days that are not stale are left out, so a day can't be stored
    twice; a stale day without fresh bars disappears.
    """
    day = F.to_date("ts")
    on = list(keys)
    kept = stored.withColumn("date", day).join(stale, on, "left_anti").drop("date")
    return kept.unionByName(fresh.withColumn("date", day).join(stale, on, "left_semi").drop("date"))
