"""Walk-forward splits with purge and embargo, and signals fitted on training bars alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import timeframe
from ..session import ship_package

# Least purge and embargo in bars.
FLOORS = {"1min": 1440, "5min": 288, "15min": 96, "30min": 48, "1h": 24, "4h": 30, "1D": 5}


#: Bars of a stretch in range joins.
STRETCH = 256


class WalkForwardError(ValueError):
    """A split that can't be made as asked."""


def purge_embargo(name: str, holding_bars: int = 1) -> tuple[int, int]:
    """Purge and embargo of a timeframe: its floor, or the holding time if that is longer."""
    if holding_bars < 1:
        raise WalkForwardError("a position is held for at least one bar")
    size = max(FLOORS[timeframe(name)], int(holding_bars))
    return size, size


def windows_of(lengths: DataFrame, train: int, test: int, purge: int, embargo: int, start: int = 0, expanding: bool = False) -> DataFrame:
    """Windows of every series in ``lengths``, a row of which has the series' keys and its length ``n``.

    Returns the keys and ``w, test_lo, test_hi, train_lo, train_hi`` (upper ends
    open). Test windows tile forward. Training excludes ``embargo`` bars after
    every earlier test window; a window left without training bars is an error.
    """
    if train < 1 or test < 1 or purge < 0 or embargo < 0 or start < 0:
        raise WalkForwardError("sizes must be at least 1, and purge, embargo and start at least 0")
    keys = [c for c in lengths.columns if c != "n"]
    first = start + train + purge
    count = F.expr(f"(n - {first}) div {test}")
    numbered = lengths.where(F.col("n") >= first + test).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("w"))
    lo = F.lit(first) + F.col("w") * test
    out = numbered.select(*keys, "w", lo.alias("test_lo"), (lo + test).alias("test_hi"), (F.lit(start).cast("long") if expanding else F.greatest(F.lit(start).cast("long"), lo - purge - train)).alias("train_lo"), (lo - purge).alias("train_hi"))
    # After the first test window, a tile of ``test`` bars keeps those beyond the embargo.
    untouched = F.least(F.col("train_hi"), F.lit(first + test)) > F.col("train_lo")
    end, begin = F.col("train_hi") - first - test, F.greatest(F.col("train_lo"), F.lit(first + test)) - (first + test)

    def kept_before(x: Column) -> Column:
        return F.floor(x / test) * (test - embargo) + F.greatest(F.lit(0), F.pmod(x, F.lit(test)) - embargo)

    kept = F.lit(0) if embargo >= test else kept_before(end) - kept_before(begin)
    empty = out.where(~untouched & (kept <= 0)).take(1)
    if empty:
        raise WalkForwardError(f"window {empty[0]['w']} has no training bars left after the embargo")
    return out


def windows(spark: SparkSession, n_bars: int, train: int, test: int, purge: int, embargo: int, start: int = 0, expanding: bool = False) -> DataFrame:
    """Windows of one series of ``n_bars`` bars."""
    return windows_of(spark.createDataFrame([(n_bars,)], "n bigint"), train, test, purge, embargo, start, expanding)


def _keys(split: DataFrame) -> list[str]:
    return [c for c in split.columns if c not in ("w", "test_lo", "test_hi", "train_lo", "train_hi")]


def _inside(bars: DataFrame, split: DataFrame, index: str, lo: str, hi: str) -> DataFrame:
    """Bars joined with the windows of their own series that cover them.

    The range join is an equi-join on stretches of ``STRETCH`` bars, each window
    once for each stretch that it touches; so it costs what windows cover, and a
    long series is spread over its stretches.
    """
    keys, i = _keys(split), F.col(index)
    touched = split.where(F.col(hi) > F.col(lo)).withColumn("_stretch", F.explode(F.expr(f"sequence({lo} div {STRETCH}, ({hi} - 1) div {STRETCH})")))
    dealt = bars.withColumn("_stretch", F.expr(f"`{index}` div {STRETCH}"))
    return dealt.join(touched, [*keys, "_stretch"]).where((i >= F.col(lo)) & (i < F.col(hi))).drop("_stretch")


def training(split: DataFrame, bars: DataFrame, embargo: int, index: str = "i") -> DataFrame:
    """Bars of each window's training set: in its range, and in no earlier test window's embargo.

    Test windows tile forward from the first one, so the embargo after the one
    before a bar is arithmetic: bars of a tile's first ``embargo`` places, from the
    second tile on.
    """
    i, size = F.col(index), F.col("test_hi") - F.col("test_lo")
    first = F.col("test_lo") - F.col("w") * size
    barred = (i >= first + size) & (F.pmod(i - first, size) < embargo)
    return _inside(bars, split, index, "train_lo", "train_hi").where(~barred)


def testing(split: DataFrame, bars: DataFrame, index: str = "i") -> DataFrame:
    return _inside(bars, split, index, "test_lo", "test_hi")


def fit_zscore(train: DataFrame, feature: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``w, n_train, mean, std`` (population) of the training values of each window, by series."""
    return train.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n_train"), F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("std"))


def zscore_sign(value: Column, mean: Column) -> Column:
    """Sign of the standardised value; the deviation's scale can't change it."""
    return F.signum(value - mean)


def run(split: DataFrame, bars: DataFrame, feature: str, outcome: str, embargo: int) -> DataFrame:
    """By window: ``n_train, n_test, signal_sum, pnl`` of the z-score sign, fitted on its training bars only."""
    keys = _keys(split)
    state = fit_zscore(training(split, bars, embargo), feature, tuple(keys))
    position = zscore_sign(F.col(feature), F.col("mean"))
    return testing(split, bars).join(state, [*keys, "w"]).withColumn("_s", position).groupBy(*keys, "w").agg(F.first("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.sum("_s").alias("signal_sum"), F.sum(F.col("_s") * F.col(outcome)).alias("pnl"))


def run_functions(split: DataFrame, bars: DataFrame, feature: str, outcome: str, embargo: int, fit: Callable[[list[float]], Any], signal: Callable[[Any, float], float], index: str = "i") -> DataFrame:
    """As ``run``, with Python functions: ``fit`` gets a window's training values alone, ``signal`` its state and one value.

    A window's bars are one group: its training and its test rows, and no others.
    """
    keys = _keys(split)
    ship_package(bars.sparkSession)
    rows = training(split, bars, embargo, index).withColumn("_test", F.lit(False)).unionByName(testing(split, bars, index).withColumn("_test", F.lit(True)))
    rows = rows.select(*keys, "w", F.col(index).alias("i"), F.col(feature).alias("x"), F.col(outcome).alias("y"), "_test")

    def window(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        train, test = frame[~frame["_test"]], frame[frame["_test"]]
        state = fit([float(v) for v in train["x"]])
        position = [float(signal(state, float(v))) for v in test["x"]]
        out = frame[[*keys, "w"]].head(1).copy()
        return out.assign(n_train=len(train), n_test=len(test), signal_sum=sum(position), pnl=sum(p * float(r) for p, r in zip(position, test["y"], strict=True)))

    schema = "".join(f"`{k}` {dict(split.dtypes)[k]}, " for k in keys) + "w bigint, n_train bigint, n_test bigint, signal_sum double, pnl double"
    return rows.groupBy(*keys, "w").applyInPandas(window, schema)


def returns(bars: DataFrame, price: str, keys: tuple[str, ...] = ("pair",), order: str = "ts") -> DataFrame:
    """Bars with ``i``, ``forward`` (next less this) and ``previous`` (this less the one before); 0 at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = F.col(price)
    return bars.withColumns({"i": F.row_number().over(w) - 1, "forward": F.coalesce(F.lead(price).over(w) - p, F.lit(0.0)), "previous": F.coalesce(p - F.lag(price).over(w), F.lit(0.0))})
