"""Currency pairs: precision, pips, prices and order arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Digits after the point by quote currency, pips, and the pairs with the lower spread ceiling.
JPY_DIGITS, OTHER_DIGITS = 3, 5
JPY_PIP, OTHER_PIP = 0.01, 0.0001
UNIVERSE = ("EURUSD", "GBPUSD", "USDJPY", "USDCHF", "USDCAD", "AUDUSD", "NZDUSD", "EURGBP", "EURJPY", "GBPJPY", "EURCHF", "AUDJPY")
MAJORS = ("EURUSD", "GBPUSD", "USDJPY", "USDCHF", "USDCAD", "AUDUSD", "NZDUSD")
CEILING_MAJOR, CEILING_CROSS = 20.0, 40.0


def normalise_symbol(symbol: Column) -> Column:
    """Six upper-case letters without separators; anything else is an error."""
    plain = F.upper(F.regexp_replace(F.trim(symbol), "[_/]", ""))
    return F.when(plain.rlike("^[A-Z]{6}$"), plain).otherwise(F.raise_error(F.concat(F.lit("not a pair: "), symbol)))


def is_symbol(symbol: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(symbol), "[_/]", "")).rlike("^[A-Z]{6}$")


def base(pair: Column) -> Column:
    return F.substring(pair, 1, 3)


def quote(pair: Column) -> Column:
    return F.substring(pair, 4, 3)


def underscored(pair: Column) -> Column:
    return F.concat_ws("_", base(pair), quote(pair))


def precision(pair: Column) -> Column:
    return F.when(quote(pair) == "JPY", F.lit(JPY_DIGITS)).otherwise(F.lit(OTHER_DIGITS))


def divisor(pair: Column) -> Column:
    """Points of a price unit; prices are points divided by it, never times its inverse."""
    return F.when(quote(pair) == "JPY", F.lit(10**JPY_DIGITS)).otherwise(F.lit(10**OTHER_DIGITS)).cast("double")


def pip_size(pair: Column) -> Column:
    return F.when(quote(pair) == "JPY", F.lit(JPY_PIP)).otherwise(F.lit(OTHER_PIP))


def spread_ceiling(pair: Column) -> Column:
    """Pips above which the 99.9th percentile of an hour's spread is an outlier."""
    return F.when(pair.isin(*MAJORS), F.lit(CEILING_MAJOR)).otherwise(F.lit(CEILING_CROSS))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def side_of(units: Column) -> Column:
    """buy or sell; zero units is an error."""
    return F.when(units > 0, "buy").when(units < 0, "sell").otherwise(F.raise_error(F.lit("an order of zero units has no side")))


def opposite(side: Column) -> Column:
    return F.when(side == "buy", "sell").when(side == "sell", "buy").otherwise(F.raise_error(F.concat(F.lit("unknown side "), side)))


def pair_dim(spark: SparkSession, pairs: tuple[str, ...] = UNIVERSE) -> DataFrame:
    """One row per pair with all that derives from its name; as many rows as pairs named."""
    p = F.col("pair")
    return spark.createDataFrame([(x,) for x in pairs], "pair string").select(
        "pair", base(p).alias("base"), quote(p).alias("quote"), underscored(p).alias("underscored"), precision(p).alias("digits"), divisor(p).alias("divisor"), pip_size(p).alias("pip"), spread_ceiling(p).alias("ceiling_pips")
    )
