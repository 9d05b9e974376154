"""Queries of reports and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import backtest as T
from ..operators import bars as B
from ..operators import checks as K
from ..operators import costs as C
from ..operators import coverage as V
from ..operators import quality as Q
from ..operators import reports as R
from .queries_market import BACK_SQL, HOLES_SQL, MANIFEST_SQL, PROBES_SQL, _PIVOT, aimed, back, found_holes, manifest, rounded, survey
from .queries_ticks import _CEILING, _stats_sql
from .registry import RAW_SQL, SQL, TICKS_SQL, bars_sql, local_sql, open_sql, query, raw_ticks, session_sql, ticks

_AT = "(date::TIMESTAMP + INTERVAL 1 HOUR * hour)"


@query("boundary_audit", f"WITH {MANIFEST_SQL} SELECT pair, count(*) FILTER (NOT {open_sql(_AT)} AND status <> 'closed') AS closed_but_answered, count(*) FILTER (NOT {open_sql(_AT)} AND decoded_ticks > 0) AS closed_but_traded, count(*) FILTER ({open_sql(_AT)} AND status = 'empty') AS open_but_empty FROM manifest GROUP BY pair")
def boundary_audit(spark, d):
    return R.boundary_audit(manifest(spark, d))


_COMPLETE = f"complete AS (SELECT pair, expected, ok, gaps, ticks, CASE WHEN expected > 0 THEN round(ok / expected, 6) END AS share FROM (SELECT pair, count(*) FILTER ({open_sql(_AT)}) AS expected, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'gap') AS gaps, sum(written_ticks)::BIGINT AS ticks FROM manifest GROUP BY pair))"


@query("completeness", f"WITH {MANIFEST_SQL}, {_COMPLETE} SELECT * FROM complete")
def completeness(spark, d):
    return R.completeness(manifest(spark, d))


@query("extremes", f"WITH {HOLES_SQL}, l AS (SELECT pair AS hole_pair, start AS hole_start, trading_days AS hole_days FROM holes ORDER BY trading_days DESC, start DESC, pair DESC LIMIT 1), s AS (SELECT pair, round(avg(CASE WHEN kind = 'data' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM series GROUP BY pair), w AS (SELECT pair AS worst_pair, share AS worst_share FROM s ORDER BY share, pair LIMIT 1) SELECT * FROM w, l")
def extremes(spark, d):
    days = survey(spark, d)[0]
    share = days.groupBy("pair").agg(F.round(F.avg((F.col("kind") == "data").cast("double")), 6).alias("share"))
    return R.extremes(share, found_holes(days))


@query("quality_trend", f"WITH {TICKS_SQL}, s AS (SELECT *, hour_start::DATE AS date FROM ({_stats_sql('ticks', 'pair, hour_start')}) WHERE hour(hour_start) = 13), o AS (SELECT * FROM s WHERE p99_9_pips <= {_CEILING}), e AS (SELECT pair, min(date) AS first, arg_min(median_pips, date) AS first_pips, max(date) AS last, arg_max(median_pips, date) AS last_pips, count(*) AS n FROM o GROUP BY pair) SELECT pair, first, first_pips, last, last_pips, round(first_pips / last_pips, 6) AS ratio FROM e WHERE n >= 2")
def quality_trend(spark, d):
    from ..functions.pairs import spread_ceiling

    s = rounded(Q.spread_stats(ticks(spark, d), ["pair", "hour_start"])).where(F.hour("hour_start") == 13)
    return R.quality_trend(s.select("pair", F.to_date("hour_start").alias("date"), "ticks", "median_pips", (F.col("p99_9_pips") <= spread_ceiling(F.col("pair"))).alias("ok")))


@query("survey_against_store", f"WITH {MANIFEST_SQL.replace(RAW_SQL + ',', RAW_SQL + ',')}, {_COMPLETE}, {PROBES_SQL[PROBES_SQL.index('n AS (SELECT pair'):]}, c AS (SELECT pair, {_PIVOT} FROM series GROUP BY pair) SELECT pair, round(data / (data + empty + missing + error + unprobed), 6) AS probed_share, share AS stored_share FROM complete JOIN c USING (pair)")
def survey_against_store(spark, d):
    return R.survey_against_store(V.counts_by_year(survey(spark, d)[0]), manifest(spark, d))


_EXTENT = " UNION ALL ".join(f"SELECT '{t}' AS timeframe, pair, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM ({bars_sql(cal.TIMEFRAMES[t])}) GROUP BY pair" for t in ("1h", "4h", "1D"))


@query("bar_extent", f"WITH {TICKS_SQL} {_EXTENT}")
def bar_extent(spark, d):
    return R.bar_extent(B.bars_of_timeframes(ticks(spark, d), ["1h", "4h", "1D"]))


@query(
    "store_report",
    f"""WITH {MANIFEST_SQL}, {_COMPLETE}, p AS (SELECT pair, {session_sql('ts')} AS session, (ask - bid) / (CASE WHEN pair[4:6] = 'JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END) AS pips FROM ticks),
    a AS (SELECT pair, round(quantile_cont(pips, 0.5), 6) AS median_pips, round(quantile_cont(pips, 0.99), 6) AS p99_pips, count(*) AS all_ticks FROM p GROUP BY pair),
    s AS (SELECT pair, session, count(*) AS n FROM p GROUP BY 1, 2), b AS (SELECT pair, arg_max(session, (n, session)) AS busiest_session, max(n) AS busiest_ticks FROM s GROUP BY pair)
    SELECT * FROM complete LEFT JOIN a USING (pair) LEFT JOIN b USING (pair)""",
)
def store_report(spark, d):
    return rounded(R.store_report(ticks(spark, d), manifest(spark, d)))


@query("build_throughput", "WITH c AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN '1h' WHEN 1 THEN '4h' ELSE '1D' END AS timeframe, o_custkey % 31 AS dates, o_orderkey % 900 AS rows, (o_orderkey % 40)::DOUBLE / 4 AS seconds FROM orders) SELECT timeframe, count(*) AS builds, sum(dates)::BIGINT AS dates, sum(rows)::BIGINT AS rows, round(sum(seconds), 2) AS seconds FROM c GROUP BY 1")
def build_throughput(spark, d):
    k = F.col("o_orderkey")
    b = F.struct(F.when(k % 3 == 0, "1h").when(k % 3 == 1, "4h").otherwise("1D").alias("timeframe"), (F.col("o_custkey") % 31).alias("dates"), (k % 900).alias("rows"), ((k % 40).cast("double") / 4).alias("seconds"))
    return R.build_throughput(spark.read.parquet(f"{d}/orders.parquet").select(F.array(b).alias("bars")))


@query("ladder_rules", f"""WITH {BACK_SQL}, r AS (SELECT pair AS name, m AS multiplier, count(*) AS n, sum(-units * mid) AS gross, sum(spread_cost) * m AS spread_cost, sum(commission) * m AS commission FROM exec, (VALUES (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) l(m) GROUP BY 1, 2),
    t AS (SELECT *, spread_cost + commission AS total FROM r), v AS (SELECT name, CASE WHEN max(gross - total) FILTER (multiplier = 1.5) > 0 THEN 'SURVIVES' WHEN max(gross - total) FILTER (multiplier = 1.2) > 0 THEN 'PARKED' ELSE 'DEAD' END AS implied FROM t WHERE NOT (name = 'GBPUSD' AND multiplier = 1.5) GROUP BY name)
    SELECT name, 'COST_LADDER_INCOMPLETE' AS reason FROM v WHERE name = 'GBPUSD' UNION ALL SELECT name, 'COST_LADDER_INCONSISTENT' FROM v WHERE name = 'USDJPY' UNION ALL SELECT name, 'SURVIVAL_VERDICT_MISMATCH' FROM v WHERE implied <> 'DEAD'""")
def ladder_rules(spark, d):
    """Rungs of each pair, one missing and one costing less than a lower rung, all stated as dead."""
    _, done = back(spark, d)
    m = F.explode(F.array(*map(F.lit, C.LADDER))).alias("multiplier")
    r = done.select("pair", "units", "mid", "spread_cost", "commission", m).groupBy(F.col("pair").alias("name"), "multiplier").agg(F.sum(-F.col("units") * F.col("mid")).alias("gross"), (F.sum("spread_cost") * F.col("multiplier")).alias("spread_cost"), (F.sum("commission") * F.col("multiplier")).alias("commission"))
    total = F.col("spread_cost") + F.col("commission")
    r = r.withColumns({"total_costs": total, "net": F.col("gross") - total, "verdict": F.lit("DEAD")}).where("not (name = 'GBPUSD' and multiplier = 1.5)")
    return K.ladder_failures(r.withColumn("total_costs", F.when((F.col("name") == "USDJPY") & (F.col("multiplier") == 2.0), F.lit(1.0)).otherwise(F.col("total_costs"))))


@query("rung_rules", "WITH r AS (SELECT o_orderkey, o_totalprice AS gross, CASE WHEN o_orderkey % 9 = 0 THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS total, CASE WHEN o_orderkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS off FROM orders) SELECT printf('R%d', o_orderkey) AS name, 1.0::DOUBLE AS multiplier, 'COST_ARITHMETIC' AS reason FROM r WHERE off > 0 UNION ALL SELECT printf('R%d', o_orderkey), 1.0::DOUBLE, 'COST_ZEROED' FROM r WHERE total = 0")
def rung_rules(spark, d):
    k = F.col("o_orderkey")
    total = F.when(k % 9 == 0, 0.0).otherwise(10.0)
    r = spark.read.parquet(f"{d}/orders.parquet").select(F.format_string("R%d", k).alias("name"), F.lit(1.0).alias("multiplier"), F.col("o_totalprice").alias("gross"), total.alias("total_costs"), (total * 0.25).alias("spread_cost"), (total * 0.75 + F.when(k % 7 == 0, 1.0).otherwise(0.0)).alias("commission"), F.lit(3).alias("trade_count"))
    return K.rung_failures(r.withColumn("net", F.col("gross") - F.col("total_costs")))


@query("scope_rules", "WITH r AS (SELECT printf('R%d', o_orderkey) AS name, o_orderkey % 3 <> 0 AS scored, CASE o_orderkey % 4 WHEN 0 THEN 'mechanical' WHEN 1 THEN 'exploratory' ELSE 'scoring' END AS mode, o_orderkey % 11 <> 0 AS scorable, o_orderdate::DATE >= DATE '1997-01-01' AS sealed FROM orders) SELECT name, 'SEAL_SCOPE_BREACH' AS reason FROM r WHERE (scored AND (mode <> 'scoring' OR NOT scorable OR sealed)) OR (NOT scored AND sealed AND mode <> 'mechanical')")
def scope_rules(spark, d):
    k = F.col("o_orderkey")
    mode = F.when(k % 4 == 0, "mechanical").when(k % 4 == 1, "exploratory").otherwise("scoring")
    r = spark.read.parquet(f"{d}/orders.parquet").select(F.format_string("R%d", k).alias("name"), (k % 3 != 0).alias("scored"), mode.alias("mode"), (k % 11 != 0).alias("scorable"), F.array(F.to_date("o_orderdate")).alias("dates"))
    return K.scope_failures(r, "1997-01-01")


@query("tick_invariants", f"WITH {RAW_SQL}, r AS (SELECT count(*) - 1 AS n FROM raw GROUP BY pair, ts, bid, ask, bid_volume, ask_volume) SELECT count(*) FILTER (bid > ask) AS crossed, count(*) FILTER (bid <= 0 OR ask <= 0) AS non_positive, count(*) FILTER (isodow({local_sql('ts', cal.WEEK_ZONE)}) = 6) AS saturday, (SELECT sum(n)::BIGINT FROM r) AS repeated FROM raw")
def tick_invariants(spark, d):
    return K.tick_invariants(raw_ticks(spark, d))


@query("hours_in_store", f"WITH {TICKS_SQL} SELECT DISTINCT pair, ts::DATE AS date, hour(ts)::INTEGER AS hour FROM ticks")
def hours_in_store(spark, d):
    from ..sources.store import hours_present, read_ticks
    from .queries_logs import stored

    return hours_present(read_ticks(spark, stored(spark, d)))


@query("backtest_document", f"WITH {BACK_SQL} SELECT part, n FROM (SELECT 'summary' AS part, 1::BIGINT AS n UNION ALL SELECT 'trade', count(*) FROM booked UNION ALL SELECT 'equity', count(*) FROM curve)")
def backtest_document(spark, d):
    bars = aimed(spark, d)
    done = T.executions(bars, C.CostModel())
    trades, curve = T.trades(done), T.equity(bars, done)
    return R.result_document(trades, curve, T.summary(bars, trades, curve)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_flags", f"""WITH {HOLES_SQL}, h AS (SELECT pair, sum(trading_days)::BIGINT AS gone, max(trading_days) AS longest FROM holes GROUP BY pair), lengths AS (SELECT pair, count(*) AS days FROM series GROUP BY pair), y AS (SELECT s.pair, start, round((date_diff('day', start, (SELECT max(date) FROM series)) + 1) / 365.25::DOUBLE, 2) AS years FROM starts s),
    r AS (SELECT y.pair, start, years, max(years) OVER () AS longest_years, coalesce(gone, 0) / days::DOUBLE AS hole_share, coalesce(longest, 0) AS longest_hole FROM y JOIN lengths USING (pair) LEFT JOIN h USING (pair))
    SELECT pair, years, concat_ws(', ', CASE WHEN start IS NULL THEN 'no start' END, CASE WHEN years < 0.9 * longest_years THEN 'short history' END, CASE WHEN hole_share > 0.02 THEN 'holes' END, CASE WHEN longest_hole >= 20 THEN 'long hole' END) AS flags FROM r""")
def coverage_flags(spark, d):
    from ..functions.text import years_between
    from .queries_market import NEAR, SHARE

    days = survey(spark, d)[0]
    starts = V.recommended_start(days, SHARE, NEAR)
    h = found_holes(days).groupBy("pair").agg(F.sum("trading_days").alias("gone"), F.max("trading_days").alias("longest"))
    n = days.groupBy("pair").agg(F.count(F.lit(1)).alias("days"))
    last = days.agg(F.max("date").alias("last"))
    y = starts.select("pair", "start").crossJoin(last).withColumn("years", years_between(F.col("start"), F.col("last")))
    most = y.agg(F.max("years").alias("longest_years"))
    r = y.crossJoin(most).join(n, "pair").join(h, "pair", "left")
    r = r.withColumns({"hole_share": F.coalesce("gone", F.lit(0)) / F.col("days"), "longest_hole": F.coalesce("longest", F.lit(0)), "quality_ok": F.lit(True)})
    return V.flags(r).select("pair", "years", F.array_join("flags", ", ").alias("flags"))


@query("replayed_ticks", f"WITH {TICKS_SQL} SELECT seq, pair, ts, bid FROM ticks WHERE pair IN ('EURUSD', 'USDJPY') ORDER BY ts, seq LIMIT 500")
def replayed_ticks(spark, d):
    from ..sources.feeds import replay_rows

    return replay_rows(ticks(spark, d), ["EURUSD", "USDJPY"], 500).select("seq", "pair", "ts", "bid")


@query("python_strategy", f"WITH {BACK_SQL} SELECT pair, ts, target FROM aimed")
def python_strategy(spark, d):
    """The moving-average rule as a strategy in Python, a bar at a time."""
    from .strategies import Crossing

    return T.strategy_target(B.bars(ticks(spark, d), "1h").select("pair", "ts", "mid_close"), Crossing).select("pair", "ts", "target")


@query("python_walk_forward", SQL["wf_pnl_by_window"])
def python_walk_forward(spark, d):
    """The z-score sign through Python functions of training values."""
    from ..operators import walkforward as W
    from .queries_market import EMBARGO, split_bars
    from .strategies import mean_of, sign_of

    split, bars = split_bars(spark, d)
    return rounded(W.run_functions(split, bars, "previous", "forward", EMBARGO, mean_of, sign_of), 9)
