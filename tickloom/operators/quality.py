"""De-duplication, validation and spread statistics of hours of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import market_open
from ..functions.pairs import pip_size, spread_ceiling

HOUR = ("pair", "hour_start")
VALUES = ("ts", "bid", "ask", "bid_volume", "ask_volume")
HARD = ("NON_POSITIVE_PRICE", "CROSSED_QUOTE", "CLOSED_MARKET_TICK", "TICK_OUTSIDE_HOUR")
SOFT = ("SPREAD_OUTLIER",)


def dedup(ticks: DataFrame) -> DataFrame:
    """First occurrence (by ``seq``) of each whole record within its hour; other prices at one instant are no duplicates."""
    others = [c for c in ticks.columns if c not in (*HOUR, *VALUES, "seq")]
    return ticks.groupBy(*HOUR, *VALUES).agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in others]).select(*ticks.columns)


def dedup_counts(ticks: DataFrame) -> DataFrame:
    """Records, kept and dropped by hour."""
    distinct = ticks.groupBy(*HOUR, *VALUES).agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(*HOUR).agg(F.sum("n").alias("decoded"), F.count(F.lit(1)).alias("kept")).withColumn("dropped", F.col("decoded") - F.col("kept"))


def offences() -> dict[str, Column]:
    """A predicate for each hard reason; all are evaluated."""
    ts, hour = F.col("ts"), F.col("hour_start")
    return {
        "NON_POSITIVE_PRICE": (F.col("bid") <= 0) | (F.col("ask") <= 0),
        "CROSSED_QUOTE": F.col("bid") > F.col("ask"),
        "CLOSED_MARKET_TICK": ~market_open(ts),
        "TICK_OUTSIDE_HOUR": (ts < hour) | (ts >= hour + F.expr("INTERVAL 1 HOUR")),
    }


def issues(ticks: DataFrame) -> DataFrame:
    """``pair, hour_start, reason, count, first_seq`` for every reason that an hour gives, hard and soft.

    One aggregation by hour; counts are pre-aggregated. The first offender is
    that with the smallest ``seq``.
    """
    bad = offences()
    aggs = []
    for reason, predicate in bad.items():
        aggs += [F.count_if(predicate).alias(f"n_{reason}"), F.min(F.when(predicate, F.col("seq"))).alias(f"s_{reason}")]
    pips = (F.col("ask") - F.col("bid")) / pip_size(F.col("pair"))
    wide = ticks.groupBy(*HOUR).agg(*aggs, F.percentile(pips, F.lit(0.999)).alias("p99_9"))
    outlier = F.col("p99_9") > spread_ceiling(F.col("pair"))
    rows = [F.struct(F.lit(r).alias("reason"), F.col(f"n_{r}").alias("count"), F.col(f"s_{r}").alias("first_seq")) for r in bad]
    rows.append(F.struct(F.lit(SOFT[0]).alias("reason"), outlier.cast("long").alias("count"), F.lit(None).cast("long").alias("first_seq")))
    return wide.select(*HOUR, F.explode(F.array(*rows)).alias("i")).select(*HOUR, "i.*").where("count > 0")


def rejected_hours(found: DataFrame) -> DataFrame:
    """Hours with any hard reason."""
    return found.where(F.col("reason").isin(*HARD)).select(*HOUR).distinct()


def accepted(ticks: DataFrame, found: DataFrame) -> DataFrame:
    """Ticks of hours that no hard reason rejects; an hour is kept or dropped whole."""
    return ticks.join(rejected_hours(found), list(HOUR), "left_anti")


def spread_stats(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Median, mean, 99th, 99.9th percentile and largest spread in pips; exact, linear between ranks."""
    pips = (F.col("ask") - F.col("bid")) / pip_size(F.col("pair"))
    p = ticks.withColumn("_pips", pips).groupBy(*keys).agg(F.count(F.lit(1)).alias("ticks"), F.percentile("_pips", F.array(F.lit(0.5), F.lit(0.99), F.lit(0.999))).alias("_p"), F.avg("_pips").alias("mean_pips"), F.max("_pips").alias("max_pips"))
    return p.select(*keys, "ticks", F.get("_p", F.lit(0)).alias("median_pips"), "mean_pips", F.get("_p", F.lit(1)).alias("p99_pips"), F.get("_p", F.lit(2)).alias("p99_9_pips"), "max_pips")


def quality_rows(ticks: DataFrame) -> DataFrame:
    """The spot check of each hour: counts, extremes, spread, and whether it passes."""
    clean = dedup(ticks)
    stats = spread_stats(clean, list(HOUR))
    basics = clean.groupBy(*HOUR).agg(F.round(F.min("bid"), 8).alias("min_bid"), F.round(F.min("ask"), 8).alias("min_ask"), F.count_if(F.col("bid") > F.col("ask")).alias("crossed_ticks"), F.count_if((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("non_positive_ticks"))
    hard = rejected_hours(issues(clean)).withColumn("_hard", F.lit(True))
    out = stats.join(basics, list(HOUR)).join(dedup_counts(ticks).select(*HOUR, "decoded", "dropped"), list(HOUR)).join(hard, list(HOUR), "left")
    return out.withColumn("ok", F.col("_hard").isNull() & (F.col("p99_9_pips") <= spread_ceiling(F.col("pair")))).drop("_hard")


def out_of_order(ticks: DataFrame) -> DataFrame:
    """How many ticks of each hour come before the one ahead of them in ``seq``; should be zero."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy(*HOUR).orderBy("seq"))
    return ticks.withColumn("_back", F.col("ts") < before).groupBy(*HOUR).agg(F.count_if("_back").alias("backwards"))
