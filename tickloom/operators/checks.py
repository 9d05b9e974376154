"""Rules that results must keep, each as rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .costs import LADDER

TOLERANCE = 1e-6


def rung_failures(rungs: DataFrame) -> DataFrame:
    """``name, multiplier, reason`` from ``name, multiplier, gross, spread_cost, commission, total_costs, net, trade_count``.

    COST_ARITHMETIC: the parts don't add up. COST_ZEROED: trades without costs.
    """
    wrong = (F.abs(F.col("spread_cost") + F.col("commission") - F.col("total_costs")) > TOLERANCE) | (F.abs(F.col("gross") - F.col("total_costs") - F.col("net")) > TOLERANCE)
    zero = (F.col("trade_count") > 0) & ((F.col("total_costs") <= TOLERANCE) | (F.abs(F.col("gross") - F.col("net")) <= TOLERANCE))
    reasons = F.array_compact(F.array(F.when(wrong, "COST_ARITHMETIC"), F.when(zero, "COST_ZEROED")))
    return rungs.select("name", "multiplier", F.explode(reasons).alias("reason"))


def ladder_failures(rungs: DataFrame, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """``name, reason``: rungs that are missing, costs that fall as the multiplier rises, a stated verdict that the ladder denies.

    ``verdict`` is the stated one, the same on all rungs of a name, or null.
    """
    at = {m: F.max(F.when(F.col("multiplier") == m, F.col("total_costs"))) for m in ladder}
    net = {m: F.max(F.when(F.col("multiplier") == m, F.col("net"))) for m in (1.2, 1.5)}
    g = rungs.groupBy("name").agg(*[v.alias(f"c{i}") for i, v in enumerate(at.values())], net[1.2].alias("n12"), net[1.5].alias("n15"), F.max("verdict").alias("stated"))
    costs = [F.col(f"c{i}") for i in range(len(ladder))]
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in costs])
    falls = reduce(lambda a, b: a | b, [F.coalesce(b < a - TOLERANCE, F.lit(False)) for a, b in zip(costs, costs[1:], strict=False)])
    implied = F.when(F.col("n15") > 0, "SURVIVES").when(F.col("n12") > 0, "PARKED").otherwise("DEAD")
    reasons = F.array_compact(F.array(F.when(missing, "COST_LADDER_INCOMPLETE"), F.when(falls, "COST_LADDER_INCONSISTENT"), F.when(F.col("stated") != implied, "SURVIVAL_VERDICT_MISMATCH")))
    return g.select("name", F.explode(reasons).alias("reason"))


def scope_failures(results: DataFrame, cutoff: str = "2025-03-01") -> DataFrame:
    """``name, reason`` from ``name, mode, scored, scorable, dates``: scored outside scoring mode, on data that may not be scored, or on sealed dates."""
    sealed = F.exists("dates", lambda d: d >= F.lit(cutoff).cast("date"))
    scored, mode = F.col("scored"), F.col("mode")
    breach = (scored & ((mode != "scoring") | ~F.col("scorable") | sealed)) | (~scored & sealed & (mode != "mechanical"))
    return results.where(breach).select("name", F.lit("SEAL_SCOPE_BREACH").alias("reason"))


def tick_invariants(ticks: DataFrame) -> DataFrame:
    """One row of counts that should all be zero: crossed, not positive, Saturday ticks, and repeated records."""
    from ..functions.calendar import WEEK_ZONE, local

    values = ["pair", "ts", "bid", "ask", "bid_volume", "ask_volume"]
    saturday = F.weekday(local(F.col("ts"), WEEK_ZONE)) == 5
    bad = ticks.agg(F.count_if(F.col("bid") > F.col("ask")).alias("crossed"), F.count_if((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("non_positive"), F.count_if(saturday).alias("saturday"))
    repeats = ticks.groupBy(*values).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated"))
    return bad.crossJoin(repeats)
