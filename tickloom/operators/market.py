"""Statistics of returns, across time and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import roll_hour
from ..functions.pairs import base, pip_size, quote


def log_returns(bars: DataFrame, price: str = "mid_close") -> DataFrame:
    w = Window.partitionBy("pair").orderBy("ts")
    return bars.select("pair", "ts", F.log(F.col(price) / F.lag(price).over(w)).alias("r")).where("r is not null")


def return_stats(returns: DataFrame) -> DataFrame:
    """Count, mean, deviation, skewness and excess kurtosis by pair."""
    return returns.groupBy("pair").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("deviation"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"))


def autocorrelation(returns: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Correlation of returns, and of their sizes, with those some bars before, by pair and lag."""
    w = Window.partitionBy("pair").orderBy("ts")
    out = None
    for k in lags:
        one = returns.withColumn("_b", F.lag("r", k).over(w)).where("_b is not null").groupBy("pair").agg(F.corr("r", "_b").alias("autocorr"), F.corr(F.abs("r"), F.abs("_b")).alias("size_autocorr")).withColumn("lag", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def split_half(returns: DataFrame) -> DataFrame:
    """Mean and deviation of the first and second half of each pair's returns."""
    half = F.ntile(2).over(Window.partitionBy("pair").orderBy("ts"))
    return returns.withColumn("half", half).groupBy("pair", "half").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("deviation"))


def volatility_terciles(returns: DataFrame, span: int) -> DataFrame:
    """Returns with the deviation of the last ``span`` and its tercile within the pair."""
    w = Window.partitionBy("pair").orderBy("ts")
    v = returns.withColumn("vol", F.when(F.count("r").over(w.rowsBetween(1 - span, 0)) == span, F.stddev_samp("r").over(w.rowsBetween(1 - span, 0)))).where("vol is not null")
    return v.withColumn("tercile", F.ntile(3).over(Window.partitionBy("pair").orderBy("vol", "ts")))


def pair_correlation(returns: DataFrame) -> DataFrame:
    """Correlation of each two pairs over the instants that both have."""
    b = returns.select(F.col("pair").alias("other"), "ts", F.col("r").alias("_b"))
    return returns.join(b, "ts").where(F.col("pair") < F.col("other")).groupBy("pair", "other").agg(F.corr("r", "_b").alias("corr"), F.count(F.lit(1)).alias("n"))


def lead_lag(returns: DataFrame, step_micros: int, lags: tuple[int, ...]) -> DataFrame:
    """Correlation of a pair's return with another's some steps before."""
    shift = F.explode(F.array(*map(F.lit, lags))).alias("lag")
    b = returns.select(F.col("pair").alias("leader"), "ts", F.col("r").alias("_b"), shift).select("leader", F.timestamp_micros(F.unix_micros("ts") + F.col("lag") * step_micros).alias("ts"), "_b", "lag")
    return returns.join(b, "ts").where("pair <> leader").groupBy("pair", "leader", "lag").agg(F.corr("r", "_b").alias("corr"), F.count(F.lit(1)).alias("n"))


def cointegration_slope(bars: DataFrame, price: str = "mid_close") -> DataFrame:
    """Least-squares slope and intercept of each pair's log price on another's, and the residual's deviation."""
    p = bars.select("pair", "ts", F.log(price).alias("y"))
    x = p.select(F.col("pair").alias("other"), "ts", F.col("y").alias("x"))
    both = p.join(x, "ts").where(F.col("pair") < F.col("other"))
    return both.groupBy("pair", "other").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.sqrt((F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")) / F.count(F.lit(1))).alias("residual"))


# Fixed value: the five-percent point of the residual test for two series with a constant, in large samples.
RESIDUAL_TEST = -3.34


def cointegration_test(bars: DataFrame, price: str = "mid_close", below: float = RESIDUAL_TEST) -> DataFrame:
    """Whether each pair's log price less its least-squares line on another's returns to its mean.

    ``statistic`` is the t-value of the residual's change on the residual before,
    without a constant or further lags; ``stationary`` whether it is below the
    critical value. Scans over many pairs should pass a stricter one.
    """
    p = bars.select("pair", "ts", F.log(price).alias("y"))
    x = p.select(F.col("pair").alias("other"), "ts", F.col("y").alias("x"))
    both = p.join(x, "ts").where(F.col("pair") < F.col("other"))
    line = cointegration_slope(bars, price).select("pair", "other", "slope", "intercept")
    rest = both.join(F.broadcast(line), ["pair", "other"]).withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    w = Window.partitionBy("pair", "other").orderBy("ts")
    step = rest.withColumn("_b", F.lag("e").over(w)).where("_b is not null").withColumn("_d", F.col("e") - F.col("_b"))
    sums = step.groupBy("pair", "other").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_b") * F.col("_b")).alias("bb"), F.sum(F.col("_b") * F.col("_d")).alias("bd"), F.sum(F.col("_d") * F.col("_d")).alias("dd"))
    rho = F.col("bd") / F.col("bb")
    error = F.sqrt((F.col("dd") - rho * F.col("bd")) / (F.col("n") - 1) / F.col("bb"))
    return sums.select("pair", "other", "n", rho.alias("reversion"), (rho / error).alias("statistic"), (rho / error < below).alias("stationary"))


def currency_strength(returns: DataFrame) -> DataFrame:
    """Mean return of a currency at an instant over the pairs it is in, with the sign of its side."""
    sides = F.explode(F.array(F.struct(base(F.col("pair")).alias("currency"), F.col("r").alias("v")), F.struct(quote(F.col("pair")).alias("currency"), (-F.col("r")).alias("v")))).alias("s")
    return returns.select("ts", sides).groupBy("ts", "s.currency").agg(F.avg("s.v").alias("strength"), F.count(F.lit(1)).alias("pairs"))


def horizon_costs(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """By pair and horizon: median size of the move in pips, median spread, and their ratio."""
    w = Window.partitionBy("pair").orderBy("ts")
    pip, out = pip_size(F.col("pair")), None
    for h in horizons:
        move = F.abs(F.lead("mid_close", h).over(w) - F.col("mid_close")) / pip
        one = bars.withColumn("_m", move).where("_m is not null").groupBy("pair").agg(F.percentile("_m", F.lit(0.5)).alias("move_pips"), F.percentile((F.col("ask_close") - F.col("bid_close")) / pip, F.lit(0.5)).alias("spread_pips")).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("moves_per_spread", F.col("move_pips") / F.col("spread_pips"))


def without_roll(rows: DataFrame) -> DataFrame:
    """Rows outside the roll hours."""
    return rows.where(~roll_hour(F.col("ts")))
