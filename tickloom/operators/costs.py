"""Transaction costs: quoted or recorded spread, tiered commission, and conversion to dollars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import session_label
from ..functions.pairs import base, quote

# The commission's rate and floor, and the stress ladder.
RATE, FLOOR = 2e-05, 2.0
LADDER = (1.0, 1.2, 1.5, 2.0)


@dataclass(frozen=True)
class CostModel:
    """Prices orders that have ``side, units, bid, ask`` (and ``ts`` for recorded spreads).

    The fill crosses the quoted spread, or lies half a recorded spread from mid
    if ``spread_by_session`` is given. The commission is the greater of rate and
    floor; the multiplier scales both costs afterwards.
    """

    rate: float = RATE
    floor: float = FLOOR
    multiplier: float = 1.0
    spread_by_session: tuple[tuple[str, float], ...] | None = None
    default_spread: float = 0.0

    def price(self, orders: DataFrame) -> DataFrame:
        """Orders with ``mid, fill, spread_cost, commission, total_cost``; a quote with bid above ask is an error."""
        buy, units = F.col("side") == "buy", F.abs("units")
        checked = F.when(F.col("bid") > F.col("ask"), F.raise_error(F.lit("crossed quote"))).otherwise((F.col("bid") + F.col("ask")) / 2)
        out = orders.withColumn("mid", checked)
        if self.spread_by_session is None:
            out = out.withColumn("fill", F.when(buy, F.col("ask")).otherwise(F.col("bid")))
            out = out.withColumn("spread_cost", F.abs(F.col("fill") - F.col("mid")) * units * self.multiplier)
        else:
            label, spread = session_label(F.col("ts")), F.lit(None).cast("double")
            for name, value in self.spread_by_session:
                spread = F.when(label == name, F.lit(float(value))).otherwise(spread)
            out = out.withColumn("_half", F.coalesce(spread, F.lit(float(self.default_spread))) / 2)
            out = out.withColumn("fill", F.when(buy, F.col("mid") + F.col("_half")).otherwise(F.col("mid") - F.col("_half")))
            out = out.withColumn("spread_cost", F.col("_half") * units * self.multiplier).drop("_half")
        out = out.withColumn("commission", F.greatest(F.lit(self.rate) * (units * F.col("fill")), F.lit(self.floor)) * self.multiplier)
        return out.withColumn("total_cost", F.col("spread_cost") + F.col("commission"))


def verdict(net_by_multiplier: DataFrame) -> DataFrame:
    """From ``multiplier, net``: SURVIVES if still positive at 1.5, PARKED at 1.2, else DEAD."""
    net = {m: F.max(F.when(F.col("multiplier") == m, F.col("net"))) for m in (1.2, 1.5)}
    return net_by_multiplier.agg(F.when(net[1.5] > 0, "SURVIVES").when(net[1.2] > 0, "PARKED").otherwise("DEAD").alias("verdict"))


def as_of(left: DataFrame, quotes: DataFrame, keys: list[str], value: str, alias: str, bucket_micros: int = 86_400_000_000) -> DataFrame:
    """``left`` with the latest ``value`` at or before its ``ts`` among rows of equal ``keys``; none: null.

    Rows are dealt by key and time bucket, so that a hot key is spread over its
    buckets; into each bucket goes one row with the last value before it, from a
    running window over buckets alone. Within a bucket both sides are unioned and
    sorted once, quotes before other rows of the same instant; nothing later than
    a row can reach it.
    """
    cols, kind = left.columns, dict(quotes.dtypes)[value]
    at = F.floor(F.unix_micros("ts") / bucket_micros).cast("long").alias("_b")
    a = left.select(*keys, at, "ts", F.lit(2).alias("_turn"), F.lit(None).cast(kind).alias("_v"), F.struct(*cols).alias("_row"))
    none = F.lit(None).cast(a.schema["_row"].dataType).alias("_row")
    b = quotes.where(F.col(value).isNotNull()).select(*keys, at, "ts", F.lit(1).alias("_turn"), F.col(value).alias("_v"), none)
    ends = b.groupBy(*keys, "_b").agg(F.max_by("_v", "ts").alias("_last")).unionByName(a.select(*keys, "_b").distinct().withColumn("_last", F.lit(None).cast(kind)))
    ends = ends.groupBy(*keys, "_b").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_v", F.last("_last", ignorenulls=True).over(before)).where("_v is not null").select(*keys, "_b", F.timestamp_micros(F.col("_b") * bucket_micros).alias("ts"), F.lit(0).alias("_turn"), "_v", none)
    w = Window.partitionBy(*keys, "_b").orderBy("ts", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).unionByName(carried).withColumn(alias, F.last("_v", ignorenulls=True).over(w)).where("_turn = 2").select("_row.*", alias)


def dollar_pair(pair: Column) -> Column:
    """The pair whose mid converts the quote currency to dollars; null if it is the dollar."""
    q = quote(pair)
    return F.when(q == "USD", F.lit(None)).when(q.isin("EUR", "GBP", "AUD", "NZD"), F.concat(q, F.lit("USD"))).otherwise(F.concat(F.lit("USD"), q))


def dollar_factor(pair: Column, rate: Column) -> Column:
    """Dollars for a unit of the quote currency, given the mid of ``dollar_pair``."""
    via = dollar_pair(pair)
    return F.when(via.isNull(), F.lit(1.0)).when(base(via) == "USD", 1.0 / rate).otherwise(rate)


def dollar_costs(fills: DataFrame, mids: DataFrame, model: CostModel | None = None) -> DataFrame:
    """Fills with costs in dollars: conversion at the mid at or before the fill; the floor is in dollars."""
    model = model or CostModel()
    keyed = fills.withColumn("_via", F.coalesce(dollar_pair(F.col("pair")), F.lit("USDUSD")))
    rated = as_of(keyed, mids.select(F.col("pair").alias("_via"), "ts", "mid"), ["_via"], "mid", "_rate")
    factor = dollar_factor(F.col("pair"), F.col("_rate"))
    units = F.abs("units")
    out = rated.withColumn("to_usd", factor)
    out = out.withColumn("spread_usd", F.abs(F.col("fill") - F.col("quote_mid")) * units * F.col("to_usd") * model.multiplier)
    return out.withColumn("commission_usd", F.greatest(F.lit(model.rate) * (units * F.col("fill")) * F.col("to_usd"), F.lit(model.floor)) * model.multiplier).drop("_via", "_rate")
