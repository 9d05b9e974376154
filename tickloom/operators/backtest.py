"""Back-tests of target positions, without look-ahead.

A strategy gives a target for each bar and never sees fills. An order set by a
bar fills at the pair's next bar's opening quote, so the position after a bar
opens is the target of the bar before: orders are differences of lagged targets,
and the whole run is a handful of window expressions by pair. Only trades under
scale-in and partial exits need a fold over a pair's orders.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .costs import LADDER, CostModel, verdict


def _by_pair() -> Window:
    return Window.partitionBy("pair").orderBy("ts")


def moving_average_target(bars: DataFrame, fast: int, slow: int, units: float) -> DataFrame:
    """Bars with ``target``: ``units`` while the fast mean of mid closes is above the slow one, else 0.

    Flat until ``slow`` bars are there. Sums are over integers of a hundred
    millionth, so that equal means compare as equal.
    """
    if not 1 <= fast < slow:
        raise ValueError(f"fast ({fast}) must be at least 1 and shorter than slow ({slow})")
    close = F.round(F.col("mid_close") * 100_000_000).cast("long")
    w = _by_pair()
    total = {n: F.sum(close).over(w.rowsBetween(1 - n, 0)) for n in (fast, slow)}
    full = F.count(close).over(w.rowsBetween(1 - slow, 0)) == slow
    return bars.withColumn("target", F.when(full & (slow * total[fast] > fast * total[slow]), F.lit(float(units))).otherwise(F.lit(0.0)))


class Strategy(Protocol):
    """A strategy in Python: sees a pair's bars one by one, in time, and returns the position it wants."""

    def on_bar(self, bar) -> float: ...


def strategy_target(bars: DataFrame, make: Callable[[], Strategy]) -> DataFrame:
    """Bars with the ``target`` of a Python strategy, a fresh one for each pair.

    For strategies that columns can't express: a pair's bars go through one Python
    worker as a frame, so this suits bars, not ticks.
    """
    ship_package(bars.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        strategy, frame = make(), frame.sort_values("ts", kind="stable")
        return frame.assign(target=[float(strategy.on_bar(b)) for b in frame.itertuples(index=False)])

    schema = ", ".join(f"`{c}` {t}" for c, t in bars.dtypes if c != "target") + ", target double"
    return bars.drop("target").groupBy("pair").applyInPandas(run, schema)


def orders(bars: DataFrame) -> DataFrame:
    """Orders that ``target`` leads to: ``pair, ts, leg, units, side, bid, ask, forced``.

    Orders fill at the next bar's open; a reversal is two orders; a position at a
    pair's last bar is closed at its closing quote, marked ``forced``. Bar 0
    never trades.
    """
    w = _by_pair()
    held = F.coalesce(F.lag("target").over(w), F.lit(0.0))
    moved = bars.withColumn("held", held).withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(0.0))).withColumn("last", F.lead("ts").over(w).isNull())
    turn = (F.signum("held") * F.signum("before")) < 0

    def leg(number: int, units: Column, side_quote: str, forced: bool) -> Column:
        return F.struct(F.lit(number).alias("leg"), units.cast("double").alias("units"), F.col(f"bid_{side_quote}").alias("bid"), F.col(f"ask_{side_quote}").alias("ask"), F.lit(forced).alias("forced"))

    legs = F.array(
        F.when(turn, leg(0, -F.col("before"), "open", False)).otherwise(leg(0, F.col("held") - F.col("before"), "open", False)),
        F.when(turn, leg(1, F.col("held"), "open", False)),
        F.when(F.col("last"), leg(2, -F.col("held"), "close", True)),
    )
    out = moved.select("pair", "ts", F.explode(F.filter(legs, lambda x: x.isNotNull() & (x["units"] != 0))).alias("o")).select("pair", "ts", "o.*")
    return out.withColumn("side", F.when(F.col("units") > 0, "buy").otherwise("sell"))


def executions(bars: DataFrame, model: CostModel) -> DataFrame:
    return model.price(orders(bars))


def trades(executed: DataFrame) -> DataFrame:
    """Round trips by a fold over the orders between two flat positions.

    Adding to a position averages its entry by units; closing takes the closed
    share of the entry's costs and the whole of the closing order's. A running sum
    by pair tells where the position is flat, so that a fold holds the orders of
    one stay in the market and not a pair's whole history.
    """
    order = F.struct("ts", "leg", "units", "fill", "mid", "spread_cost", "commission", "forced")
    run = Window.partitionBy("pair").orderBy("ts", "leg", "units").rowsBetween(Window.unboundedPreceding, 0)
    flat_now = executed.withColumn("_flat", (F.sum("units").over(run) == 0).cast("long"))
    stays = flat_now.withColumn("_stay", F.sum("_flat").over(run) - F.col("_flat"))
    listed = stays.groupBy("pair", "_stay").agg(F.sort_array(F.collect_list(order)).alias("orders"))
    ts = executed.schema["ts"].dataType.simpleString()
    trade = f"struct<entry_ts:{ts},exit_ts:{ts},units:double,entry_fill:double,exit_fill:double,entry_mid:double,exit_mid:double,gross:double,spread_cost:double,commission:double,forced:boolean>"
    start = F.expr(f"named_struct('u', 0D, 'ts', cast(null as {ts}), 'fill', 0D, 'mid', 0D, 'sp', 0D, 'co', 0D, 'done', cast(array() as array<{trade}>))")

    def step(s: Column, o: Column) -> Column:
        flat, same = s["u"] == 0, F.signum(s["u"]) == F.signum(o["units"])
        size, now = F.abs(s["u"]), F.abs(o["units"])
        closing = F.least(size, now)
        share = F.when(flat, 0.0).otherwise(closing / size)
        direction = F.signum(s["u"])
        done = F.struct(
            s["ts"].alias("entry_ts"), o["ts"].alias("exit_ts"), (closing * direction).alias("units"), s["fill"].alias("entry_fill"), o["fill"].alias("exit_fill"), s["mid"].alias("entry_mid"), o["mid"].alias("exit_mid"),
            ((o["mid"] - s["mid"]) * closing * direction).alias("gross"), (s["sp"] * share + o["spread_cost"]).alias("spread_cost"), (s["co"] * share + o["commission"]).alias("commission"), o["forced"].alias("forced"),
        )
        opens = flat | same

        def mean(a: str, b: str) -> Column:
            return F.when(flat, o[b]).when(same, (s[a] * size + o[b] * now) / (size + now)).otherwise(s[a])

        return F.struct(
            (s["u"] + o["units"]).alias("u"), F.when(flat, o["ts"]).otherwise(s["ts"]).alias("ts"), mean("fill", "fill").alias("fill"), mean("mid", "mid").alias("mid"),
            F.when(opens, s["sp"] + o["spread_cost"]).otherwise(s["sp"] * (1 - share)).alias("sp"), F.when(opens, s["co"] + o["commission"]).otherwise(s["co"] * (1 - share)).alias("co"),
            F.when(opens, s["done"]).otherwise(F.concat(s["done"], F.array(done))).alias("done"),
        )

    out = listed.select("pair", F.explode(F.aggregate("orders", start, step, lambda s: s["done"])).alias("t")).select("pair", "t.*")
    return out.withColumn("net", F.col("gross") - (F.col("spread_cost") + F.col("commission")))


def equity(bars: DataFrame, executed: DataFrame, initial: float = 0.0) -> DataFrame:
    """The book after each instant: ``ts, equity``; cash of all orders less costs, and positions at the last mid.

    By pair, holdings and cash are running sums; across pairs each pair's value is
    carried forward to the instants at which it has no bar.
    """
    moves = executed.groupBy("pair", "ts").agg(F.sum("units").alias("_u"), F.sum(-F.col("units") * F.col("mid") - F.col("total_cost")).alias("_c"))
    run = _by_pair().rowsBetween(Window.unboundedPreceding, 0)
    marks = bars.join(moves, ["pair", "ts"], "left").select("pair", "ts", "mid_close", F.coalesce(F.sum("_u").over(run), F.lit(0.0)).alias("held"), F.coalesce(F.sum("_c").over(run), F.lit(0.0)).alias("cash"))
    value = marks.select("pair", "ts", (F.col("cash") + F.col("held") * F.col("mid_close")).alias("value"))
    change = value.withColumn("_d", F.col("value") - F.coalesce(F.lag("value").over(_by_pair()), F.lit(0.0)))
    by_ts = change.groupBy("ts").agg(F.sum("_d").alias("_d"))
    return _over_days(by_ts, "_d", F.sum).select("ts", (F.lit(initial) + F.col("_run")).alias("equity"))


def _over_days(rows: DataFrame, value: str, function: Callable[[str], Column]) -> DataFrame:
    """Rows with ``_run``, the sum or maximum of ``value`` up to each instant.

    It runs within each day; only the days' own results, one row a day, are
    carried on in a window without a key.
    """
    whole = rows.withColumn("_day", F.to_date("ts"))
    by_day = whole.groupBy("_day").agg(function(value).alias("_of_day"))
    before = by_day.select("_day", function("_of_day").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = function(value).over(Window.partitionBy("_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    joined = whole.withColumn("_within", within).join(before, "_day")
    both = F.coalesce("_before", F.lit(0.0)) + F.col("_within") if function is F.sum else F.greatest("_before", "_within")
    return joined.withColumn("_run", both).drop("_day", "_within", "_before")


def drawdown(curve: DataFrame) -> DataFrame:
    """Instants with their fall from the highest equity so far."""
    return _over_days(curve, "equity", F.max).withColumn("drawdown", F.col("_run") - F.col("equity")).drop("_run")


def by_pair(done: DataFrame) -> DataFrame:
    """Totals of trades by pair and, with a null pair, of all."""
    return done.rollup("pair").agg(F.count(F.lit(1)).alias("trade_count"), F.count_if(F.col("net") > 0).alias("wins"), F.sum("gross").alias("gross"), F.sum("spread_cost").alias("spread_cost"), F.sum("commission").alias("commission"), F.sum("net").alias("net"))


def summary(bars: DataFrame, done: DataFrame, curve: DataFrame) -> DataFrame:
    """One row: bars, trades, wins, costs, gross, net, last equity and the deepest drawdown."""
    t = done.agg(F.count(F.lit(1)).alias("trade_count"), F.count_if(F.col("net") > 0).alias("wins"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("gross", "spread_cost", "commission", "net")])
    d = drawdown(curve).agg(F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.max_by("equity", "ts").alias("final_equity"))
    n = bars.agg(F.count(F.lit(1)).alias("bar_count"))
    return n.crossJoin(t).crossJoin(d)


def ladder(bars: DataFrame, model: CostModel, multipliers: tuple[float, ...] = LADDER) -> DataFrame:
    """``multiplier, net`` of the same orders under each stress of the costs; one pass over the orders."""
    priced = model.price(orders(bars))
    steps = F.explode(F.array(*map(F.lit, multipliers))).alias("multiplier")
    costs = priced.select("units", "mid", "total_cost", steps)
    return costs.groupBy("multiplier").agg(F.sum(-F.col("units") * F.col("mid") - F.col("total_cost") * F.col("multiplier")).alias("net"))


def ladder_verdict(bars: DataFrame, model: CostModel) -> DataFrame:
    return verdict(ladder(bars, model))


def full_scorecard(bars: DataFrame, model: CostModel) -> DataFrame:
    """One row for bars with targets: the scorecard, net at each stress of the costs, the verdict and the deepest drawdown."""
    done = executions(bars, model)
    round_trips, curve = trades(done), equity(bars, done)
    nets = ladder(bars, model).agg(*[F.max(F.when(F.col("multiplier") == m, F.col("net"))).alias(f"net_{str(m).replace('.', '_')}") for m in LADDER])
    deepest = drawdown(curve).agg(F.max("drawdown").alias("max_drawdown"))
    return scorecard(round_trips, curve).crossJoin(nets).crossJoin(ladder_verdict(bars, model)).crossJoin(deepest)


def by_regime(round_trips: DataFrame, regime: Column) -> DataFrame:
    """Trades, hit rate, net and holding time by regime of the entry: a session, or a tercile of volatility that was joined on."""
    hold = (F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 3.6e9
    return round_trips.groupBy(regime.alias("regime")).agg(F.count(F.lit(1)).alias("trade_count"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.sum("net").alias("net"), F.avg(hold).alias("holding_hours"))


def scorecard(done: DataFrame, curve: DataFrame) -> DataFrame:
    """One row: hit rate, mean and deviation of equity changes, their ratio, turnover and holding time."""
    day = F.to_date("ts")
    ends = curve.groupBy(day.alias("_day")).agg(F.max_by("equity", "ts").alias("_close"))
    before = ends.select("_day", F.lag("_close").over(Window.orderBy("_day")).alias("_before"))
    inside = F.lag("equity").over(Window.partitionBy("_day").orderBy("ts"))
    change = curve.withColumn("_day", day).withColumn("_lag", inside).join(before, "_day").withColumn("_d", F.col("equity") - F.coalesce("_lag", "_before"))
    risk = change.agg(F.avg("_d").alias("mean_change"), F.stddev_samp("_d").alias("deviation"))
    hold = (F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 3.6e9
    t = done.agg(F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.sum(F.abs("units") * 2).alias("turnover"), F.avg(hold).alias("holding_hours"))
    return t.crossJoin(risk.withColumn("ratio", F.col("mean_change") / F.col("deviation")))
