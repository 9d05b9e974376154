"""Comparison of bars with a second source's candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pairs import pip_size

SERIES = {"mid_diff": "mid_open", "bid_offset": "bid_open", "ask_offset": "ask_open"}


def differences(bars: DataFrame, candles: DataFrame) -> DataFrame:
    """Opening differences in pips of the hours that both have; candles have ``pair, ts, mid_open, bid_open, ask_open``."""
    other = candles.select("pair", "ts", *[F.col(c).alias(f"_{c}") for c in SERIES.values()])
    pip = pip_size(F.col("pair"))
    return bars.join(other, ["pair", "ts"]).select("pair", "ts", *[((F.col(c) - F.col(f"_{c}")) / pip).alias(name) for name, c in SERIES.items()], "mid_open", F.col("_mid_open").alias("other_mid"))


def describe(diffs: DataFrame) -> DataFrame:
    """Hours compared, and mean, median, 95th percentile and largest size of each series, by pair."""
    aggs = [F.count(F.lit(1)).alias("compared")]
    for c in SERIES:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.percentile(F.abs(c), F.lit(0.95)).alias(f"{c}_p95_abs"), F.max(F.abs(c)).alias(f"{c}_max_abs")]
    return diffs.groupBy("pair").agg(*aggs)


def flagged(diffs: DataFrame, most_pips: float = 1.0) -> DataFrame:
    """Hours whose mids differ by more; bids and asks of the two sources differ by design and are not judged."""
    return diffs.where(F.abs("mid_diff") > most_pips).select("pair", "ts", "mid_diff", "mid_open", "other_mid")
