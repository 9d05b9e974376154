"""Coverage of a probed feed: series over a calendar, starts, holes and what to probe next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("data", "empty", "missing", "error")


def last_probe(probes: DataFrame, order: str = "line_no") -> DataFrame:
    """The last record of each pair, date and hour."""
    others = [c for c in probes.columns if c not in ("pair", "date", "hour")]
    return probes.groupBy("pair", "date", "hour").agg(F.max_by(F.struct(*others), order).alias("_r")).select("pair", "date", "hour", "_r.*")


def series(calendar: DataFrame, probes: DataFrame, hour: int) -> DataFrame:
    """``pair, date, kind, i`` for each pair and trading day; days without a probe are ``unprobed``."""
    got = probes.where(F.col("hour") == hour).select("pair", "date", "kind")
    i = F.row_number().over(Window.partitionBy("pair").orderBy("date")) - 1
    return calendar.join(got, ["pair", "date"], "left").select("pair", "date", F.coalesce("kind", F.lit("unprobed")).alias("kind")).withColumn("i", i)


def counts(days: DataFrame) -> DataFrame:
    """Days of each kind by pair; every kind has a column."""
    return days.groupBy("pair").pivot("kind", [*KINDS, "unprobed"]).count().na.fill(0)


def counts_by_year(days: DataFrame) -> DataFrame:
    return days.groupBy("pair", F.year("date").alias("year")).pivot("kind", [*KINDS, "unprobed"]).count().na.fill(0)


def fractions(days: DataFrame, window: int) -> DataFrame:
    """Probed days with the share of data over the next ``window`` probed days and over all that follow."""
    w = Window.partitionBy("pair").orderBy("date")
    flag = (F.col("kind") == "data").cast("double")
    return days.where("kind <> 'unprobed'").select("pair", "date", "kind", F.avg(flag).over(w.rowsBetween(0, window - 1)).alias("near"), F.avg(flag).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("far"), F.count(F.lit(1)).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("days_left"))


def recommended_start(days: DataFrame, fraction: float, window: int) -> DataFrame:
    """By pair: the first data day whose near and far shares reach ``fraction``, and the first data day at all.

    Pairs without a probed day have nulls.
    """
    f = fractions(days, window).where("kind = 'data'")
    ok = f.where((F.col("near") >= fraction) & (F.col("far") >= fraction))
    pick = F.struct("date", "near", "far", "days_left")
    chosen = ok.groupBy("pair").agg(F.min_by(pick, "date").alias("c"))
    first = f.groupBy("pair").agg(F.min_by(pick, "date").alias("d"))
    out = days.select("pair").distinct().join(first, "pair", "left").join(chosen, "pair", "left")
    return out.select(
        "pair", F.col("c.date").alias("start"), F.round("c.near", 6).alias("near"), F.round("c.far", 6).alias("far"), F.coalesce("c.days_left", F.lit(0)).cast("long").alias("days_from_start"),
        F.col("d.date").alias("first_data"), F.round("d.near", 6).alias("first_near"), F.round("d.far", 6).alias("first_far"),
    )


def holes(days: DataFrame, least: int, starts: DataFrame | None = None) -> DataFrame:
    """Longest runs of at least ``least`` trading days without data, at or after the pair's start.

    Unprobed days count inside a run. Returns ``pair, start, end, trading_days,
    composition`` (a map from kind to days), with the places of both ends.
    """
    considered = days
    if starts is not None:
        considered = days.join(starts.select("pair", F.col("start").alias("_since")), "pair", "left").where("_since is null or date >= _since").drop("_since")
    island = F.sum((F.col("kind") == "data").cast("int")).over(Window.partitionBy("pair").orderBy("date"))
    out = considered.withColumn("_run", island).where("kind <> 'data'")
    by_kind = out.groupBy("pair", "_run", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"), F.min("i").alias("ia"), F.max("i").alias("ib"))
    runs = by_kind.groupBy("pair", "_run").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.sum("n").alias("trading_days"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("composition"), F.min("ia").alias("first_i"), F.max("ib").alias("last_i"))
    return runs.where(F.col("trading_days") >= least).drop("_run")


def evidence(probes: DataFrame, hour: int) -> DataFrame:
    """What other hours of a day answered: ``hours`` (map from hour to kind), ``data_hours``, ``any_data``."""
    other = probes.where(F.col("hour") != hour)
    listed = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.format_string("%02d", F.col("hour").cast("int")).alias("hour"), "kind"))))
    return other.groupBy("pair", "date").agg(listed.alias("hours"), F.count_if(F.col("kind") == "data").alias("data_hours")).withColumn("any_data", F.col("data_hours") > 0)


def hole_verdicts(found: DataFrame, refined: DataFrame) -> DataFrame:
    """Holes joined with the evidence inside them: unrefined, whole-day, hour-specific or partial.

    The range condition is joined by pair and month, so that each day of evidence
    meets only the holes of its month.
    """
    month = F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("INTERVAL 1 MONTH")))
    keyed = found.select("pair", "start", "end", "trading_days", month.alias("_m"))
    days = refined.select("pair", F.trunc("date", "MM").alias("_m"), "date", "any_data")
    inside = keyed.join(days, ["pair", "_m"]).where(F.col("date").between(F.col("start"), F.col("end")))
    n = inside.groupBy("pair", "start").agg(F.count(F.lit(1)).alias("refined_days"), F.count_if("any_data").alias("with_data"))
    out = found.join(n, ["pair", "start"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("refined_days", "with_data")})
    r, d = F.col("refined_days"), F.col("with_data")
    return out.withColumn("verdict", F.when(r == 0, "unrefined").when(d == 0, "whole-day").when(d == r, "hour-specific").otherwise("partial"))


def start_context(days: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """Days of each kind in the ``window`` days before and from the start."""
    at = days.join(starts.select("pair", F.col("start").alias("date")), ["pair", "date"]).select("pair", F.col("i").alias("_at"))
    near = days.join(at, "pair").where((F.col("i") >= F.col("_at") - window) & (F.col("i") < F.col("_at") + window))
    side = F.when(F.col("i") < F.col("_at"), "before").otherwise("after")
    return near.groupBy("pair", side.alias("side"), "kind").agg(F.count(F.lit(1)).alias("days"))


def quality_targets(probes: DataFrame, count: int) -> DataFrame:
    """``count`` data probes of each pair, evenly spread over its history; halves round to even."""
    dated = probes.where("kind = 'data'").select("pair", "date", "hour").distinct()
    w = Window.partitionBy("pair")
    placed = dated.withColumns({"_i": F.row_number().over(w.orderBy("date", "hour")) - 1, "_n": F.count(F.lit(1)).over(w)})
    if count <= 1:
        return placed.where("_i = 0").select("pair", "date", "hour")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * ((F.col("_n") - 1) / F.lit(count - 1)).cast("double"), 0).cast("int"))
    return placed.where(F.array_contains(wanted, F.col("_i"))).select("pair", "date", "hour")


def refine_targets(days: DataFrame, starts: DataFrame, found: DataFrame, hours: tuple[int, ...], boundary: int, most: int) -> DataFrame:
    """Other hours to probe around starts and at the ends and middle of holes; at most ``most`` by pair, in order."""
    at = days.join(starts.select("pair", F.col("start").alias("date")), ["pair", "date"]).select("pair", F.col("i").alias("_at"))
    around = at.select("pair", F.posexplode(F.sequence(F.col("_at") - boundary, F.col("_at") + boundary)).alias("_p", "i")).select("pair", F.lit(0).alias("_g"), F.lit(None).cast("date").alias("_s"), "_p", "i")
    middle = F.expr("(first_i + last_i) div 2").cast("int")
    places = F.array(F.col("first_i") - 1, F.col("first_i"), middle, F.col("last_i"), F.col("last_i") + 1)
    at_holes = found.select("pair", F.lit(1).alias("_g"), F.col("start").alias("_s"), F.posexplode(places).alias("_p", "i"))
    first = around.unionByName(at_holes).groupBy("pair", "i").agg(F.min(F.struct("_g", "_s", "_p")).alias("_o"))
    dated = first.join(days.select("pair", "i", "date"), ["pair", "i"])
    listed = dated.select("pair", "date", "_o", F.posexplode(F.array(*map(F.lit, hours))).alias("_h", "hour"))
    rank = F.row_number().over(Window.partitionBy("pair").orderBy("_o", "_h"))
    return listed.withColumn("_r", rank).where(F.col("_r") <= most).select("pair", "date", "hour")


def flags(report: DataFrame) -> DataFrame:
    """From ``years, longest_years, hole_share, longest_hole, quality_ok, start``: the reasons to look at a pair."""
    rules = [
        (F.col("start").isNull(), "no start"), (F.col("years") < 0.9 * F.col("longest_years"), "short history"), (F.col("hole_share") > 0.02, "holes"),
        (F.col("longest_hole") >= 20, "long hole"), (~F.col("quality_ok"), "quality"),
    ]
    return report.withColumn("flags", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules])))
