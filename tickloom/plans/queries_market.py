"""Queries on hours, costs, back-tests, coverage, splits and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import pairs as fx
from ..operators import backtest as T
from ..operators import bars as B
from ..operators import costs as C
from ..operators import coverage as V
from ..operators import crosscheck as X
from ..operators import manifest as M
from ..operators import market as K
from ..operators import quality as Q
from ..operators import walkforward as W
from .queries_ticks import _REASONS, _VALS
from .registry import PAIRS, PIP_SQL, RAW_SQL, TICKS_SQL, bars_sql, open_sql, query, raw_ticks, session_sql, ticks


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Hours and manifests


def grid(spark, d) -> DataFrame:
    """All pairs, days and hours of the events' days."""
    days = spark.read.parquet(f"{d}/events.parquet").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    pairs = spark.createDataFrame([(p,) for p in PAIRS], "pair string")
    return days.crossJoin(F.broadcast(pairs)).select("pair", "date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))


def hours(spark, d) -> DataFrame:
    raw = raw_ticks(spark, d)
    clean = Q.dedup(raw.select("pair", "hour_start", "ts", "bid", "ask", "bid_volume", "ask_volume", "seq"))
    bad = Q.rejected_hours(Q.issues(clean)).withColumn("rejected", F.lit(True))
    n = Q.dedup_counts(raw).join(bad, ["pair", "hour_start"], "left")
    return n.select("pair", F.to_date("hour_start").alias("date"), F.hour("hour_start").alias("hour"), F.col("kept").alias("ticks"), F.col("dropped").alias("duplicates"), F.coalesce("rejected", F.lit(False)).alias("rejected"))


def manifest(spark, d) -> DataFrame:
    return M.manifest(grid(spark, d), hours(spark, d))


_HARD = " OR ".join(f"({p})" for p in _REASONS.values())
_PAIRS = ", ".join(f"('{p}')" for p in PAIRS)
DAYS_SQL = "days AS (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM events)"
GRID_SQL = f"{DAYS_SQL}, names(pair) AS (VALUES {_PAIRS}), grid AS (SELECT pair, date, unnest(generate_series(0, 23))::INTEGER AS hour FROM days, names)"
MANIFEST_SQL = f"""{RAW_SQL}, {GRID_SQL},
one AS (SELECT {_VALS}, count(*) AS n FROM raw GROUP BY ALL),
got AS (SELECT pair, hour_start::DATE AS date, hour(hour_start)::INTEGER AS hour, count(*) AS ticks, (sum(n) - count(*))::BIGINT AS duplicates, bool_or({_HARD}) AS rejected FROM one GROUP BY 1, 2, 3),
placed AS (SELECT *, date::TIMESTAMP + INTERVAL 1 HOUR * hour AS spot FROM grid LEFT JOIN got USING (pair, date, hour)),
judged AS (SELECT *, CASE WHEN coalesce(rejected, false) THEN 'gap' WHEN coalesce(ticks, 0) > 0 THEN 'ok' WHEN {open_sql('spot')} THEN 'empty' ELSE 'closed' END AS status FROM placed),
manifest AS (SELECT pair, date, hour, status, coalesce(ticks, 0) AS decoded_ticks, CASE WHEN status = 'ok' THEN ticks ELSE 0 END AS written_ticks, coalesce(duplicates, 0) AS duplicates_dropped, status = 'empty' AS empty_trading_hour FROM judged)"""
BY_DAY_SQL = "SELECT pair, date, count(*) AS hours_requested, count(*) FILTER (status = 'ok') AS hours_ok, count(*) FILTER (status IN ('empty', 'closed')) AS hours_empty, count(*) FILTER (status = 'gap') AS hours_gap, sum(written_ticks)::BIGINT AS ticks, sum(duplicates_dropped)::BIGINT AS duplicates_dropped FROM manifest GROUP BY 1, 2"


@query("request_grid", f"WITH {GRID_SQL} SELECT * FROM grid")
def request_grid(spark, d):
    return grid(spark, d)


@query("manifest_status", f"WITH {MANIFEST_SQL} SELECT * FROM manifest")
def manifest_status(spark, d):
    return manifest(spark, d)


@query("coverage_by_day", f"WITH {MANIFEST_SQL} {BY_DAY_SQL}")
def coverage_by_day(spark, d):
    return M.coverage_by_day(manifest(spark, d))


WHOLE = 4


@query(
    "tick_count_outliers",
    f"""WITH {MANIFEST_SQL}, d AS ({BY_DAY_SQL}), w AS (SELECT *, hours_ok >= {WHOLE} AS whole_trading_day, CASE WHEN hours_ok >= {WHOLE} AND ticks > 0 THEN ticks END AS past FROM d),
    m AS (SELECT * EXCLUDE (past), CASE WHEN count(past) OVER o >= 3 THEN (quantile_cont(past::DOUBLE, 0.5) OVER o) END AS trailing_median FROM w WINDOW o AS (PARTITION BY pair ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT *, coalesce(whole_trading_day AND trailing_median > 0 AND (ticks < 0.25 * trailing_median OR ticks > 4 * trailing_median), false) AS tick_count_outlier FROM m""",
)
def tick_count_outliers(spark, d):
    return M.tick_count_outliers(M.coverage_by_day(manifest(spark, d)), whole_day_hours=WHOLE)


@query("coverage_summary", f"WITH {MANIFEST_SQL}, s(status) AS (VALUES ('ok'), ('empty'), ('closed'), ('gap')) SELECT s.status, count(m.status) AS hours, coalesce(sum(written_ticks), 0)::BIGINT AS ticks, coalesce(sum(duplicates_dropped), 0)::BIGINT AS duplicates_dropped FROM s LEFT JOIN manifest m ON s.status = m.status GROUP BY s.status")
def coverage_summary(spark, d):
    return M.coverage_summary(manifest(spark, d))


@query("manifest_totals", f"WITH {MANIFEST_SQL} SELECT pair, year(date)::INTEGER AS year, count(*) AS hours, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'gap') AS gaps, count(*) FILTER (empty_trading_hour) AS warnings, sum(written_ticks)::BIGINT AS ticks, count(DISTINCT date) AS days, min(date) AS first_date, max(date) AS last_date FROM manifest GROUP BY ROLLUP (pair, year(date)::INTEGER)")
def manifest_totals(spark, d):
    return M.totals(manifest(spark, d))


@query("gap_topk", f"WITH {MANIFEST_SQL} SELECT pair, date, hour, (SELECT count(*) FROM manifest WHERE status = 'gap') AS gaps FROM manifest WHERE status = 'gap' ORDER BY 1, 2, 3 LIMIT 25")
def gap_topk(spark, d):
    return M.gap_list(manifest(spark, d), 25)


@query("resume_antijoin", f"WITH {MANIFEST_SQL}, stored AS (SELECT pair, date, hour FROM manifest WHERE status = 'ok' AND hour % 5 <> 0) SELECT pair, date, hour FROM grid ANTI JOIN (SELECT pair, date, hour FROM manifest WHERE status IN ('empty', 'closed') UNION ALL SELECT * FROM stored) USING (pair, date, hour)")
def resume_antijoin(spark, d):
    m = manifest(spark, d)
    return M.pending(grid(spark, d), m, m.where("status = 'ok' and hour % 5 <> 0").select("pair", "date", "hour"))


@query("manifest_upsert", f"WITH {MANIFEST_SQL} SELECT pair, date, hour, CASE WHEN status = 'gap' AND hour % 2 = 0 THEN 'ok' ELSE status END AS status, CASE WHEN status = 'gap' AND hour % 2 = 0 THEN decoded_ticks ELSE written_ticks END AS written_ticks FROM manifest")
def manifest_upsert(spark, d):
    m = manifest(spark, d).select("pair", "date", "hour", "status", "written_ticks", "decoded_ticks")
    again = m.where("status = 'gap' and hour % 2 = 0").withColumns({"status": F.lit("ok"), "written_ticks": F.col("decoded_ticks")})
    return M.upsert(m, again).drop("decoded_ticks")


@query("holidays", f"WITH {MANIFEST_SQL}, o AS (SELECT date, pair, count(*) FILTER (status = 'ok') AS ok FROM manifest WHERE {open_sql('(date::TIMESTAMP + INTERVAL 1 HOUR * hour)')} GROUP BY 1, 2) SELECT date FROM o GROUP BY date HAVING max(ok) <= 12")
def holidays(spark, d):
    return M.holidays(manifest(spark, d), 12)


@query("holiday_calendar", f"WITH {MANIFEST_SQL}, o AS (SELECT date, pair, count(*) FILTER (status = 'ok') AS ok FROM manifest WHERE {open_sql('(date::TIMESTAMP + INTERVAL 1 HOUR * hour)')} GROUP BY 1, 2), f AS (SELECT date FROM o GROUP BY date HAVING max(ok) <= 12), a AS (SELECT DISTINCT date, date IN (SELECT date FROM f) AS observed, strftime(date, '%m-%d') IN ('01-01', '12-25') AS listed FROM manifest) SELECT date, observed, listed FROM a WHERE observed OR listed")
def holiday_calendar(spark, d):
    return M.holiday_calendar(manifest(spark, d), 12)


_P = f"(ask - bid) / {PIP_SQL}"
_QS = ", ".join(f"round(quantile_cont(pips, {p}), 6) AS {n}" for p, n in ((0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.99, "p99"), (0.999, "p99_9")))


@query("spread_by_session", f"WITH {TICKS_SQL}, p AS (SELECT pair, {session_sql('ts')} AS session, {_P} AS pips FROM ticks) SELECT pair, session, count(*) AS ticks, {_QS}, round(avg(pips), 6) AS mean, round(max(pips), 6) AS max FROM p GROUP BY 1, 2 UNION ALL SELECT pair, 'all', count(*), {_QS}, round(avg(pips), 6), round(max(pips), 6) FROM p GROUP BY 1")
def spread_by_session(spark, d):
    return rounded(M.spread_by_session(ticks(spark, d)))


@query("session_spread", f"WITH {TICKS_SQL}, s(session) AS (VALUES {', '.join(f'({x!r})' for x in cal.SESSIONS)}), p AS (SELECT {session_sql('ts')} AS session, {_P} AS pips FROM ticks) SELECT s.session, count(pips) AS ticks, round(avg(pips), 6) AS mean, {_QS.replace('round(quantile_cont(pips, 0.75), 6) AS p75, ', '')} FROM s LEFT JOIN p ON s.session = p.session GROUP BY s.session")
def session_spread(spark, d):
    return M.session_spread(ticks(spark, d))


@query("hourly_profile", f"WITH {TICKS_SQL}, h AS (SELECT unnest(generate_series(0, 23))::INTEGER AS hour) SELECT h.hour, count(t.ts) AS ticks FROM h LEFT JOIN ticks t ON hour(t.ts) = h.hour GROUP BY h.hour")
def hourly_profile(spark, d):
    return M.hourly_profile(ticks(spark, d))


# Costs and back-tests

FAST, SLOW, UNITS = 3, 8, 100_000.0
ORDERS_SQL = f"{TICKS_SQL}, priced AS (SELECT seq, pair, ts, CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, (seq % 17 + 1) * 10000.0::DOUBLE AS units, bid, ask, (bid + ask) / 2 AS mid FROM ticks)"


def order_rows(spark, d) -> DataFrame:
    s = F.col("seq")
    return ticks(spark, d).select("seq", "pair", "ts", F.when(s % 2 == 0, "buy").otherwise("sell").alias("side"), ((s % 17 + 1) * 10000.0).alias("units"), "bid", "ask")


@query("cost_model_quoted", f"WITH {ORDERS_SQL}, f AS (SELECT *, CASE WHEN side = 'buy' THEN ask ELSE bid END AS fill FROM priced) SELECT seq, fill, round(abs(fill - mid) * units * 1.2::DOUBLE, 6) AS spread_cost, round(greatest(2e-05::DOUBLE * (units * fill), 2.0::DOUBLE) * 1.2::DOUBLE, 6) AS commission FROM f")
def cost_model_quoted(spark, d):
    return C.CostModel(multiplier=1.2).price(order_rows(spark, d)).select("seq", "fill", F.round("spread_cost", 6).alias("spread_cost"), F.round("commission", 6).alias("commission"))


_RECORDED = (("london", 0.00012), ("new_york", 0.00015), (cal.OVERLAP, 0.0001))
_HALF = "(CASE " + " ".join(f"WHEN s = '{n}' THEN {v}::DOUBLE" for n, v in _RECORDED) + " ELSE 0.0002::DOUBLE END) / 2"


@query("cost_model_recorded", f"WITH {ORDERS_SQL}, l AS (SELECT *, {session_sql('ts')} AS s FROM priced), h AS (SELECT *, {_HALF} AS half FROM l), f AS (SELECT *, CASE WHEN side = 'buy' THEN mid + half ELSE mid - half END AS fill FROM h) SELECT seq, round(fill, 9) AS fill, round(half * units, 6) AS spread_cost, round(greatest(2e-05::DOUBLE * (units * fill), 2.0::DOUBLE), 6) AS commission FROM f")
def cost_model_recorded(spark, d):
    out = C.CostModel(spread_by_session=_RECORDED, default_spread=0.0002).price(order_rows(spark, d))
    return out.select("seq", F.round("fill", 9).alias("fill"), F.round("spread_cost", 6).alias("spread_cost"), F.round("commission", 6).alias("commission"))


_CL = "CAST(floor(mid_close * 100000000 + 0.5) AS BIGINT)"
BACK_SQL = f"""{TICKS_SQL}, bars AS ({bars_sql(3600)}),
aimed AS (SELECT *, CASE WHEN count(*) OVER s = {SLOW} AND {SLOW} * sum({_CL}) OVER f > {FAST} * sum({_CL}) OVER s THEN {UNITS}::DOUBLE ELSE 0.0::DOUBLE END AS target FROM bars
  WINDOW f AS (PARTITION BY pair ORDER BY ts ROWS {FAST - 1} PRECEDING), s AS (PARTITION BY pair ORDER BY ts ROWS {SLOW - 1} PRECEDING)),
held AS (SELECT *, coalesce(lag(target) OVER w, 0.0::DOUBLE) AS held, lead(ts) OVER w IS NULL AS last FROM aimed WINDOW w AS (PARTITION BY pair ORDER BY ts)),
moved AS (SELECT *, held - coalesce(lag(held) OVER (PARTITION BY pair ORDER BY ts), 0.0::DOUBLE) AS delta FROM held),
orders AS (SELECT pair, ts, 0 AS leg, delta AS units, bid_open AS bid, ask_open AS ask, false AS forced FROM moved WHERE delta <> 0
  UNION ALL SELECT pair, ts, 2, -held, bid_close, ask_close, true FROM moved WHERE last AND held <> 0),
filled AS (SELECT *, (bid + ask) / 2 AS mid, CASE WHEN units > 0 THEN ask ELSE bid END AS fill FROM orders),
exec AS (SELECT *, abs(fill - mid) * abs(units) AS spread_cost, greatest(2e-05::DOUBLE * (abs(units) * fill), 2.0::DOUBLE) AS commission FROM filled),
legs AS (SELECT *, lead(struct_pack(ts := ts, fill := fill, mid := mid, sp := spread_cost, co := commission, forced := forced)) OVER (PARTITION BY pair ORDER BY ts, leg) AS x FROM exec),
trades AS (SELECT pair, ts AS entry_ts, x.ts AS exit_ts, units, fill AS entry_fill, x.fill AS exit_fill, (x.mid - mid) * units AS gross, spread_cost + x.sp AS spread_cost, commission + x.co AS commission, x.forced AS forced FROM legs WHERE units > 0),
booked AS (SELECT *, gross - (spread_cost + commission) AS net FROM trades),
moves AS (SELECT pair, ts, sum(units) AS u, sum(-units * mid - (spread_cost + commission)) AS c FROM exec GROUP BY 1, 2),
marks AS (SELECT b.pair, b.ts, mid_close, coalesce(sum(u) OVER w, 0.0::DOUBLE) AS h, coalesce(sum(c) OVER w, 0.0::DOUBLE) AS cash FROM bars b LEFT JOIN moves m ON b.pair = m.pair AND b.ts = m.ts WINDOW w AS (PARTITION BY b.pair ORDER BY b.ts ROWS UNBOUNDED PRECEDING)),
worth AS (SELECT pair, ts, cash + h * mid_close AS v FROM marks),
change AS (SELECT ts, sum(dv) AS dv FROM (SELECT ts, v - coalesce(lag(v) OVER (PARTITION BY pair ORDER BY ts), 0.0::DOUBLE) AS dv FROM worth) GROUP BY ts),
curve AS (SELECT ts, sum(dv) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM change)"""


def aimed(spark, d) -> DataFrame:
    return T.moving_average_target(B.bars(ticks(spark, d), "1h"), FAST, SLOW, UNITS)


def back(spark, d) -> tuple[DataFrame, DataFrame]:
    bars = aimed(spark, d)
    return bars, T.executions(bars, C.CostModel())


@query("sma_signal", f"WITH {BACK_SQL} SELECT pair, ts, mid_close, target FROM aimed")
def sma_signal(spark, d):
    return aimed(spark, d).select("pair", "ts", "mid_close", "target")


@query("orders_next_bar", f"WITH {BACK_SQL} SELECT pair, ts, leg, units, CASE WHEN units > 0 THEN 'buy' ELSE 'sell' END AS side, forced FROM orders")
def orders_next_bar(spark, d):
    return T.orders(aimed(spark, d)).select("pair", "ts", "leg", "units", "side", "forced")


@query("backtest_trades", f"WITH {BACK_SQL} SELECT pair, entry_ts, exit_ts, units, entry_fill, exit_fill, round(gross, 4) AS gross, round(spread_cost, 4) AS spread_cost, round(commission, 4) AS commission, round(net, 4) AS net, forced FROM booked")
def backtest_trades(spark, d):
    _, done = back(spark, d)
    return T.trades(done).select("pair", "entry_ts", "exit_ts", "units", "entry_fill", "exit_fill", *[F.round(c, 4).alias(c) for c in ("gross", "spread_cost", "commission", "net")], "forced")


@query("backtest_equity", f"WITH {BACK_SQL} SELECT ts, round(equity, 4) AS equity FROM curve")
def backtest_equity(spark, d):
    return rounded(T.equity(*back(spark, d)), 4)


@query("backtest_drawdown", f"WITH {BACK_SQL} SELECT ts, round(equity, 4) AS equity, round(max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - equity, 4) AS drawdown FROM curve")
def backtest_drawdown(spark, d):
    return rounded(T.drawdown(T.equity(*back(spark, d))), 4)


@query("backtest_by_pair", f"WITH {BACK_SQL} SELECT pair, count(*) AS trade_count, count(*) FILTER (net > 0) AS wins, round(sum(gross), 4) AS gross, round(sum(spread_cost), 4) AS spread_cost, round(sum(commission), 4) AS commission, round(sum(net), 4) AS net FROM booked GROUP BY ROLLUP (pair)")
def backtest_by_pair(spark, d):
    return rounded(T.by_pair(T.trades(back(spark, d)[1])), 4)


@query("backtest_summary", f"WITH {BACK_SQL}, t AS (SELECT count(*) AS trade_count, count(*) FILTER (net > 0) AS wins, sum(gross) AS gross, sum(spread_cost) AS spread_cost, sum(commission) AS commission, sum(net) AS net FROM booked), w AS (SELECT ts, equity, max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - equity AS dd FROM curve), e AS (SELECT max(dd) AS max_drawdown, arg_max(equity, ts) AS final_equity FROM w) SELECT (SELECT count(*) FROM bars) AS bar_count, trade_count, wins, round(gross, 4) AS gross, round(spread_cost, 4) AS spread_cost, round(commission, 4) AS commission, round(net, 4) AS net, round(max_drawdown, 4) AS max_drawdown, round(final_equity, 4) AS final_equity FROM t, e")
def backtest_summary(spark, d):
    bars, done = back(spark, d)
    return rounded(T.summary(bars, T.trades(done), T.equity(bars, done)), 4)


_NETS = "nets AS (SELECT m AS multiplier, sum(-units * mid - (spread_cost + commission) * m) AS net FROM exec, (VALUES (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) l(m) GROUP BY m)"


@query("cost_ladder", f"WITH {BACK_SQL}, {_NETS} SELECT multiplier, round(net, 4) AS net FROM nets")
def cost_ladder(spark, d):
    return rounded(T.ladder(aimed(spark, d), C.CostModel()), 4)


@query("cost_ladder_verdict", f"WITH {BACK_SQL}, {_NETS} SELECT CASE WHEN max(net) FILTER (multiplier = 1.5) > 0 THEN 'SURVIVES' WHEN max(net) FILTER (multiplier = 1.2) > 0 THEN 'PARKED' ELSE 'DEAD' END AS verdict FROM nets")
def cost_ladder_verdict(spark, d):
    return T.ladder_verdict(aimed(spark, d), C.CostModel())


@query("scorecard", f"WITH {BACK_SQL}, t AS (SELECT avg(CASE WHEN net > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate, sum(abs(units) * 2) AS turnover, avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3.6e9::DOUBLE) AS holding_hours FROM booked), r AS (SELECT avg(x) AS mean_change, stddev_samp(x) AS deviation FROM (SELECT equity - lag(equity) OVER (ORDER BY ts) AS x FROM curve)) SELECT round(hit_rate, 4) AS hit_rate, round(turnover, 4) AS turnover, round(holding_hours, 4) AS holding_hours, round(mean_change, 4) AS mean_change, round(deviation, 4) AS deviation, round(mean_change / deviation, 4) AS ratio FROM t, r")
def scorecard(spark, d):
    bars, done = back(spark, d)
    return rounded(T.scorecard(T.trades(done), T.equity(bars, done)), 4)


_CARD = "t AS (SELECT avg(CASE WHEN net > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate, sum(abs(units) * 2) AS turnover, avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3.6e9::DOUBLE) AS holding_hours FROM booked), r AS (SELECT avg(x) AS mean_change, stddev_samp(x) AS deviation FROM (SELECT equity - lag(equity) OVER (ORDER BY ts) AS x FROM curve))"


@query("full_scorecard", f"WITH {BACK_SQL}, {_NETS}, {_CARD}, l AS (SELECT {', '.join(f'max(net) FILTER (multiplier = {m}) AS net_{str(m).replace(chr(46), chr(95))}' for m in (1.0, 1.2, 1.5, 2.0))} FROM nets), d AS (SELECT max(dd) AS max_drawdown FROM (SELECT max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - equity AS dd FROM curve)) SELECT round(hit_rate, 4) AS hit_rate, round(turnover, 4) AS turnover, round(holding_hours, 4) AS holding_hours, round(mean_change, 4) AS mean_change, round(deviation, 4) AS deviation, round(mean_change / deviation, 4) AS ratio, round(net_1_0, 4) AS net_1_0, round(net_1_2, 4) AS net_1_2, round(net_1_5, 4) AS net_1_5, round(net_2_0, 4) AS net_2_0, CASE WHEN net_1_5 > 0 THEN 'SURVIVES' WHEN net_1_2 > 0 THEN 'PARKED' ELSE 'DEAD' END AS verdict, round(max_drawdown, 4) AS max_drawdown FROM t, r, l, d")
def full_scorecard(spark, d):
    return rounded(T.full_scorecard(aimed(spark, d), C.CostModel()), 4)


@query("scorecard_by_session", f"WITH {BACK_SQL} SELECT {session_sql('entry_ts')} AS regime, count(*) AS trade_count, round(avg(CASE WHEN net > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hit_rate, round(sum(net), 4) AS net, round(avg((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3.6e9::DOUBLE), 4) AS holding_hours FROM booked GROUP BY 1")
def scorecard_by_session(spark, d):
    return rounded(T.by_regime(T.trades(back(spark, d)[1]), cal.session_label(F.col("entry_ts"))), 4)


_MIDS = "mids AS (SELECT pair AS via, ts, mid_close AS mid FROM bars WHERE pair IN ('EURUSD', 'GBPUSD', 'USDJPY', 'USDCHF'))"
_RATED = f"""{TICKS_SQL}, bars AS ({bars_sql(3600)}), {_MIDS}, fills AS (SELECT seq, pair, ts, CASE WHEN seq % 2 = 0 THEN ask ELSE bid END AS fill, (bid + ask) / 2 AS quote_mid, (seq % 17 + 1) * 10000.0::DOUBLE AS units,
  CASE pair[4:6] WHEN 'USD' THEN 'USDUSD' ELSE 'USD' || pair[4:6] END AS via FROM ticks),
rated AS (SELECT f.*, CASE WHEN f.via = 'USDUSD' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / m.mid END AS to_usd FROM fills f ASOF LEFT JOIN mids m ON f.via = m.via AND f.ts >= m.ts)"""


def dollars(spark, d) -> DataFrame:
    t = ticks(spark, d)
    mids = B.bars(t, "1h").select("pair", "ts", F.col("mid_close").alias("mid"))
    s = F.col("seq")
    fills = t.select("seq", "pair", "ts", F.when(s % 2 == 0, F.col("ask")).otherwise(F.col("bid")).alias("fill"), fx.mid(F.col("bid"), F.col("ask")).alias("quote_mid"), ((s % 17 + 1) * 10000.0).alias("units"))
    return C.dollar_costs(fills, mids)


@query("asof_conversion", f"WITH {_RATED} SELECT seq, pair, round(to_usd, 9) AS to_usd FROM rated")
def asof_conversion(spark, d):
    return dollars(spark, d).select("seq", "pair", F.round("to_usd", 9).alias("to_usd"))


@query("dollar_costs", f"WITH {_RATED} SELECT seq, round(abs(fill - quote_mid) * units * to_usd, 6) AS spread_usd, round(CASE WHEN to_usd IS NULL THEN 2.0::DOUBLE ELSE greatest(2e-05::DOUBLE * (units * fill) * to_usd, 2.0::DOUBLE) END, 6) AS commission_usd FROM rated")
def dollar_costs(spark, d):
    return rounded(dollars(spark, d).select("seq", "spread_usd", "commission_usd"))


# Coverage

HOUR, OTHERS, NEAR, SHARE, LEAST = 13, (9, 11, 15), 5, 0.6, 2


def probes(spark, d) -> DataFrame:
    """A survey of the events' hours: data where there are ticks, else missing or empty; some days are not probed."""
    n = ticks(spark, d).groupBy("pair", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("ticks"))
    day = F.unix_date("date")
    g = grid(spark, d).where(F.col("hour").isin(HOUR, *OTHERS)).join(n, ["pair", "date", "hour"], "left").withColumn("_n", F.coalesce("ticks", F.lit(0)))
    g = g.withColumn("_n", F.when((day + F.ascii("pair")) % 4 == 0, F.lit(0)).otherwise(F.col("_n")))
    kind = F.when(F.col("_n") > 0, "data").when(day % 3 == 0, "missing").otherwise("empty")
    kept = g.where(F.when(F.col("hour") == HOUR, (day + F.ascii("pair")) % 13 != 0).otherwise(day % 2 == 0))
    return kept.select("pair", "date", "hour", kind.alias("kind"), F.col("_n").alias("ticks"))


_DAY = "date_diff('day', DATE '1970-01-01', date)"
PROBES_SQL = f"""{TICKS_SQL}, {GRID_SQL}, n AS (SELECT pair, ts::DATE AS date, hour(ts)::INTEGER AS hour, count(*) AS c FROM ticks GROUP BY 1, 2, 3),
surveyed AS (SELECT pair, date, hour, CASE WHEN ({_DAY} + ascii(pair)) % 4 = 0 THEN 0 ELSE coalesce(c, 0) END AS ticks FROM grid LEFT JOIN n USING (pair, date, hour) WHERE hour IN ({HOUR}, {', '.join(map(str, OTHERS))})),
probes AS (SELECT pair, date, hour, CASE WHEN ticks > 0 THEN 'data' WHEN {_DAY} % 3 = 0 THEN 'missing' ELSE 'empty' END AS kind, ticks FROM surveyed WHERE CASE WHEN hour = {HOUR} THEN ({_DAY} + ascii(pair)) % 13 <> 0 ELSE {_DAY} % 2 = 0 END),
calendar AS (SELECT pair, date FROM days, names WHERE {open_sql(f'(date::TIMESTAMP + INTERVAL {HOUR} HOUR)')}),
series AS (SELECT c.pair, c.date, coalesce(p.kind, 'unprobed') AS kind, (row_number() OVER (PARTITION BY c.pair ORDER BY c.date) - 1)::INTEGER AS i FROM calendar c LEFT JOIN (SELECT * FROM probes WHERE hour = {HOUR}) p ON c.pair = p.pair AND c.date = p.date)"""
STARTS_SQL = f"""{PROBES_SQL}, flagged AS (SELECT pair, date, kind, avg(CASE WHEN kind = 'data' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (w ROWS BETWEEN CURRENT ROW AND {NEAR - 1} FOLLOWING) AS near,
  avg(CASE WHEN kind = 'data' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS far, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS days_left FROM series WHERE kind <> 'unprobed' WINDOW w AS (PARTITION BY pair ORDER BY date)),
firsts AS (SELECT pair, min(date) AS first_data, round(arg_min(near, date), 6) AS first_near, round(arg_min(far, date), 6) AS first_far FROM flagged WHERE kind = 'data' GROUP BY pair),
chosen AS (SELECT pair, min(date) AS start, round(arg_min(near, date), 6) AS near, round(arg_min(far, date), 6) AS far, arg_min(days_left, date) AS n FROM flagged WHERE kind = 'data' AND near >= {SHARE} AND far >= {SHARE} GROUP BY pair),
starts AS (SELECT pair, start, near, far, coalesce(n, 0) AS days_from_start, first_data, first_near, first_far FROM (SELECT DISTINCT pair FROM series) LEFT JOIN firsts USING (pair) LEFT JOIN chosen USING (pair))"""
HOLES_SQL = f"""{STARTS_SQL}, islands AS (SELECT s.*, sum(CASE WHEN kind = 'data' THEN 1 ELSE 0 END) OVER (PARTITION BY s.pair ORDER BY date) AS run FROM series s JOIN starts t ON s.pair = t.pair WHERE start IS NULL OR date >= start),
holes AS (SELECT pair, min(date) AS start, max(date) AS "end", count(*) AS trading_days, min(i) AS first_i, max(i) AS last_i, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'unprobed') AS unprobed FROM islands WHERE kind <> 'data' GROUP BY pair, run HAVING count(*) >= {LEAST})"""


def survey(spark, d) -> tuple[DataFrame, DataFrame]:
    p = probes(spark, d)
    days = grid(spark, d).select("date").distinct()
    open_days = days.where(cal.market_open(F.col("date").cast("timestamp") + F.expr(f"INTERVAL {HOUR} HOURS")))
    c = open_days.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in PAIRS], "pair string"))).select("pair", "date")
    return V.series(c, p, HOUR), p


@query("probe_last_wins", f"WITH {PROBES_SQL} SELECT pair, date, hour, CASE WHEN hour = 9 THEN 'error' ELSE kind END AS kind FROM probes")
def probe_last_wins(spark, d):
    p = probes(spark, d).select("pair", "date", "hour", "kind").withColumn("line_no", F.lit(1))
    again = p.where("hour = 9").withColumns({"kind": F.lit("error"), "line_no": F.lit(2)})
    return V.last_probe(p.unionByName(again)).drop("line_no")


@query("probe_series_left_join", f"WITH {PROBES_SQL} SELECT * FROM series")
def probe_series_left_join(spark, d):
    return survey(spark, d)[0]


_PIVOT = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in (*V.KINDS, "unprobed"))


@query("probe_counts_pivot", f"WITH {PROBES_SQL} SELECT pair, {_PIVOT} FROM series GROUP BY pair")
def probe_counts_pivot(spark, d):
    return V.counts(survey(spark, d)[0])


@query("probe_counts_by_year", f"WITH {PROBES_SQL} SELECT pair, year(date)::INTEGER AS year, {_PIVOT} FROM series GROUP BY 1, 2")
def probe_counts_by_year(spark, d):
    return V.counts_by_year(survey(spark, d)[0])


@query("recommended_start", f"WITH {STARTS_SQL} SELECT * FROM starts")
def recommended_start(spark, d):
    return V.recommended_start(survey(spark, d)[0], SHARE, NEAR)


def found_holes(days: DataFrame) -> DataFrame:
    return V.holes(days, LEAST, V.recommended_start(days, SHARE, NEAR))


@query("holes_islands", f'WITH {HOLES_SQL} SELECT pair, start, "end", trading_days, missing, unprobed FROM holes')
def holes_islands(spark, d):
    n = {k: F.coalesce(F.try_element_at("composition", F.lit(k)), F.lit(0)).alias(k) for k in ("missing", "unprobed")}
    return found_holes(survey(spark, d)[0]).select("pair", "start", "end", "trading_days", *n.values())


_EVIDENCE = f"evidence AS (SELECT pair, date, count(*) AS probed, count(*) FILTER (kind = 'data') AS data_hours, count(*) FILTER (kind = 'data') > 0 AS any_data FROM probes WHERE hour <> {HOUR} GROUP BY 1, 2)"


@query("refinement_evidence", f"WITH {PROBES_SQL}, {_EVIDENCE} SELECT * FROM evidence")
def refinement_evidence(spark, d):
    e = V.evidence(survey(spark, d)[1], HOUR)
    return e.select("pair", "date", F.size("hours").cast("long").alias("probed"), "data_hours", "any_data")


@query("hole_verdicts_range_join", f'WITH {HOLES_SQL}, {_EVIDENCE}, j AS (SELECT h.pair, h.start, count(e.date) AS refined_days, count(*) FILTER (any_data) AS with_data FROM holes h LEFT JOIN evidence e ON e.pair = h.pair AND e.date BETWEEN h.start AND h."end" GROUP BY 1, 2) SELECT *, CASE WHEN refined_days = 0 THEN \'unrefined\' WHEN with_data = 0 THEN \'whole-day\' WHEN with_data = refined_days THEN \'hour-specific\' ELSE \'partial\' END AS verdict FROM j')
def hole_verdicts_range_join(spark, d):
    days, p = survey(spark, d)
    return V.hole_verdicts(found_holes(days), V.evidence(p, HOUR)).select("pair", "start", "refined_days", "with_data", "verdict")


@query("start_context", f"WITH {STARTS_SQL}, a AS (SELECT s.pair, s.i AS spot FROM series s JOIN starts t ON s.pair = t.pair AND s.date = t.start) SELECT s.pair, CASE WHEN i < spot THEN 'before' ELSE 'after' END AS side, kind, count(*) AS days FROM series s JOIN a ON s.pair = a.pair WHERE i >= spot - {NEAR} AND i < spot + {NEAR} GROUP BY 1, 2, 3")
def start_context(spark, d):
    days = survey(spark, d)[0]
    return V.start_context(days, V.recommended_start(days, SHARE, NEAR), NEAR)


@query("quality_targets", f"WITH {PROBES_SQL}, o AS (SELECT pair, date, hour, row_number() OVER (PARTITION BY pair ORDER BY date, hour) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM probes WHERE kind = 'data'), k AS (SELECT unnest(generate_series(0, 4)) AS k) SELECT DISTINCT pair, date, hour FROM o, k WHERE i = round_even(k * ((n - 1) / 4.0::DOUBLE), 0)")
def quality_targets(spark, d):
    return V.quality_targets(probes(spark, d), 5)


@query("refine_targets", f"""WITH {HOLES_SQL}, a AS (SELECT s.pair, s.i AS spot FROM series s JOIN starts t ON s.pair = t.pair AND s.date = t.start),
    wanted AS (SELECT pair, unnest(generate_series(spot - 2, spot + 2)) AS i FROM a UNION SELECT pair, unnest([first_i - 1, first_i, (first_i + last_i) // 2, last_i, last_i + 1]) FROM holes)
    SELECT s.pair, s.date, h.hour FROM wanted w JOIN series s ON s.pair = w.pair AND s.i = w.i, (SELECT unnest([{', '.join(map(str, OTHERS))}])::INTEGER AS hour) h""")
def refine_targets(spark, d):
    days = survey(spark, d)[0]
    return V.refine_targets(days, V.recommended_start(days, SHARE, NEAR), found_holes(days), OTHERS, 2, 400)


# Second source

_CANDLES = f"candles AS (SELECT pair, ts, mid_open + ((epoch_us(ts) // 3600000000) % 7 - 3) * 0.3::DOUBLE * {PIP_SQL} AS mid_open, bid_open - 0.7::DOUBLE * {PIP_SQL} AS bid_open, ask_open + 0.6::DOUBLE * {PIP_SQL} AS ask_open FROM bars WHERE hour(ts) % 4 <> 1)"
_DIFFS = f"{TICKS_SQL}, bars AS ({bars_sql(3600)}), {_CANDLES}, diffs AS (SELECT b.pair, b.ts, (b.mid_open - c.mid_open) / {PIP_SQL.replace('pair', 'b.pair')} AS mid_diff, (b.bid_open - c.bid_open) / {PIP_SQL.replace('pair', 'b.pair')} AS bid_offset, (b.ask_open - c.ask_open) / {PIP_SQL.replace('pair', 'b.pair')} AS ask_offset FROM bars b JOIN candles c ON b.pair = c.pair AND b.ts = c.ts)"


def second(spark, d) -> DataFrame:
    bars = B.bars(ticks(spark, d), "1h")
    pip, h = fx.pip_size(F.col("pair")), F.expr("unix_micros(ts) div 3600000000")
    c = bars.where(F.hour("ts") % 4 != 1).select("pair", "ts", (F.col("mid_open") + (h % 7 - 3) * F.lit(0.3) * pip).alias("mid_open"), (F.col("bid_open") - F.lit(0.7) * pip).alias("bid_open"), (F.col("ask_open") + F.lit(0.6) * pip).alias("ask_open"))
    return X.differences(bars, c)


_DESC = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.5), 6) AS {c}_median, round(quantile_cont(abs({c}), 0.95), 6) AS {c}_p95_abs, round(max(abs({c})), 6) AS {c}_max_abs" for c in X.SERIES)


@query("crosscheck_join_stats", f"WITH {_DIFFS} SELECT pair, count(*) AS compared, {_DESC} FROM diffs GROUP BY pair")
def crosscheck_join_stats(spark, d):
    return rounded(X.describe(second(spark, d)))


@query("crosscheck_flagged", f"WITH {_DIFFS} SELECT pair, ts, round(mid_diff, 6) AS mid_diff FROM diffs WHERE abs(mid_diff) > 0.75")
def crosscheck_flagged(spark, d):
    return rounded(X.flagged(second(spark, d), 0.75).select("pair", "ts", "mid_diff"))


# Walk-forward

TRAIN, TEST, PURGE, EMBARGO = 96, 48, 5, 12
SPLIT_SQL = f"""{TICKS_SQL}, bars AS ({bars_sql(3600)}),
moved AS (SELECT pair, ts, mid_close, row_number() OVER w - 1 AS i, coalesce(lead(mid_close) OVER w - mid_close, 0.0::DOUBLE) AS forward, coalesce(mid_close - lag(mid_close) OVER w, 0.0::DOUBLE) AS previous FROM bars WINDOW w AS (PARTITION BY pair ORDER BY ts)),
lengths AS (SELECT pair, count(*) AS n FROM moved GROUP BY pair),
split AS (SELECT pair, w, lo AS test_lo, lo + {TEST} AS test_hi, greatest(1, lo - {PURGE + TRAIN}) AS train_lo, lo - {PURGE} AS train_hi FROM (SELECT pair, n, w, {1 + TRAIN + PURGE} + w * {TEST} AS lo FROM (SELECT pair, n, unnest(generate_series(0, n // {TEST})) AS w FROM lengths)) WHERE lo + {TEST} <= n),
train AS (SELECT s.w, m.* FROM split s JOIN moved m ON s.pair = m.pair AND i >= train_lo AND i < train_hi WHERE NOT EXISTS (SELECT 1 FROM split e WHERE e.pair = s.pair AND e.test_lo < s.test_lo AND m.i >= e.test_hi AND m.i < e.test_hi + {EMBARGO})),
state AS (SELECT pair, w, count(*) AS n_train, avg(previous) AS mean, stddev_pop(previous) AS std FROM train GROUP BY pair, w)"""


def split_bars(spark, d) -> tuple[DataFrame, DataFrame]:
    bars = W.returns(B.bars(ticks(spark, d), "1h").select("pair", "ts", "mid_close"), "mid_close")
    lengths = bars.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return W.windows_of(lengths, TRAIN, TEST, PURGE, EMBARGO, start=1), bars


@query("forward_previous_returns", f"WITH {SPLIT_SQL} SELECT pair, ts, i::INTEGER AS i, round(forward, 9) AS forward, round(previous, 9) AS previous FROM moved")
def forward_previous_returns(spark, d):
    return split_bars(spark, d)[1].select("pair", "ts", "i", F.round("forward", 9).alias("forward"), F.round("previous", 9).alias("previous"))


@query("wf_windows", f"WITH {SPLIT_SQL} SELECT pair, w, test_lo, test_hi, train_lo, train_hi FROM split")
def wf_windows(spark, d):
    return split_bars(spark, d)[0]


@query("wf_train_fit", f"WITH {SPLIT_SQL} SELECT pair, w, n_train, round(mean, 9) AS mean, round(std, 9) AS std FROM state")
def wf_train_fit(spark, d):
    split, bars = split_bars(spark, d)
    return rounded(W.fit_zscore(W.training(split, bars, EMBARGO), "previous", ("pair",)), 9)


@query("wf_pnl_by_window", f"WITH {SPLIT_SQL}, t AS (SELECT s.pair, s.w, n_train, sign(previous - mean) AS sig, forward FROM split s JOIN state USING (pair, w) JOIN moved m ON m.pair = s.pair AND i >= test_lo AND i < test_hi) SELECT pair, w, any_value(n_train) AS n_train, count(*) AS n_test, sum(sig)::DOUBLE AS signal_sum, round(sum(sig * forward), 9) AS pnl FROM t GROUP BY pair, w")
def wf_pnl_by_window(spark, d):
    split, bars = split_bars(spark, d)
    return rounded(W.run(split, bars, "previous", "forward", EMBARGO), 9)


@query("purge_embargo", "SELECT * FROM (VALUES ('1min', 1440), ('5min', 288), ('15min', 100), ('30min', 100), ('1h', 100), ('4h', 100), ('1D', 100)) v(timeframe, bars)")
def purge_embargo(spark, d):
    return spark.createDataFrame([(t, W.purge_embargo(t, 100)[0]) for t in cal.TIMEFRAMES], "timeframe string, bars int")


# Returns

RET_SQL = f"{TICKS_SQL}, bars AS ({bars_sql(3600)}), rets AS (SELECT * FROM (SELECT pair, ts, ln(mid_close / lag(mid_close) OVER (PARTITION BY pair ORDER BY ts)) AS r FROM bars) WHERE r IS NOT NULL)"


def rets(spark, d) -> DataFrame:
    return K.log_returns(B.bars(ticks(spark, d), "1h"))


@query("return_stats", f"WITH {RET_SQL} SELECT pair, count(*) AS n, round(avg(r), 9) AS mean, round(stddev_samp(r), 9) AS deviation, round(avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5), 5) AS skewness, round(avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) - 3, 5) AS kurtosis FROM (SELECT *, avg(r) OVER (PARTITION BY pair) AS m FROM rets) GROUP BY pair")
def return_stats(spark, d):
    return K.return_stats(rets(spark, d)).select("pair", "n", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"), F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))


@query("return_autocorr", f"WITH {RET_SQL}, l AS (SELECT pair, r, lag(r, 1) OVER w AS b1, lag(r, 2) OVER w AS b2 FROM rets WINDOW w AS (PARTITION BY pair ORDER BY ts)) SELECT pair, round(corr(r, b1), 6) AS autocorr, round(corr(abs(r), abs(b1)), 6) AS size_autocorr, 1 AS lag FROM l WHERE b1 IS NOT NULL GROUP BY pair UNION ALL SELECT pair, round(corr(r, b2), 6), round(corr(abs(r), abs(b2)), 6), 2 FROM l WHERE b2 IS NOT NULL GROUP BY pair")
def return_autocorr(spark, d):
    return rounded(K.autocorrelation(rets(spark, d), (1, 2)))


@query("split_half_stability", f"WITH {RET_SQL}, h AS (SELECT pair, r, ntile(2) OVER (PARTITION BY pair ORDER BY ts)::INTEGER AS half FROM rets) SELECT pair, half, round(avg(r), 9) AS mean, round(stddev_samp(r), 9) AS deviation FROM h GROUP BY 1, 2")
def split_half_stability(spark, d):
    return rounded(K.split_half(rets(spark, d)), 9)


@query("vol_terciles", f"WITH {RET_SQL}, v AS (SELECT pair, ts, CASE WHEN count(*) OVER w = 12 THEN stddev_samp(r) OVER w END AS vol FROM rets WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 11 PRECEDING)), t AS (SELECT pair, vol, ntile(3) OVER (PARTITION BY pair ORDER BY vol, ts)::INTEGER AS tercile FROM v WHERE vol IS NOT NULL) SELECT pair, tercile, count(*) AS n, round(avg(vol), 6) AS mean_vol FROM t GROUP BY 1, 2")
def vol_terciles(spark, d):
    return K.volatility_terciles(rets(spark, d), 12).groupBy("pair", "tercile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("vol"), 6).alias("mean_vol"))


@query("pair_correlation", f"WITH {RET_SQL} SELECT a.pair, b.pair AS other, round(corr(a.r, b.r), 6) AS corr, count(*) AS n FROM rets a JOIN rets b ON a.ts = b.ts AND a.pair < b.pair GROUP BY 1, 2")
def pair_correlation(spark, d):
    return rounded(K.pair_correlation(rets(spark, d)))


@query("lead_lag", f"WITH {RET_SQL}, s AS (SELECT pair AS leader, ts + INTERVAL 1 HOUR * k AS ts, r, k AS lag FROM rets, (VALUES (1), (2)) v(k)) SELECT a.pair, leader, lag, round(corr(a.r, s.r), 6) AS corr, count(*) AS n FROM rets a JOIN s ON a.ts = s.ts AND a.pair <> leader GROUP BY 1, 2, 3")
def lead_lag(spark, d):
    return rounded(K.lead_lag(rets(spark, d), 3_600_000_000, (1, 2)))


@query("cointegration", f"WITH {RET_SQL}, p AS (SELECT pair, ts, ln(mid_close) AS y FROM bars) SELECT a.pair, b.pair AS other, round(regr_slope(a.y, b.y), 6) AS slope, round(regr_intercept(a.y, b.y), 6) AS intercept, round(sqrt((regr_syy(a.y, b.y) - regr_slope(a.y, b.y) * regr_sxy(a.y, b.y)) / count(*)), 6) AS residual FROM p a JOIN p b ON a.ts = b.ts AND a.pair < b.pair GROUP BY 1, 2")
def cointegration(spark, d):
    return rounded(K.cointegration_slope(B.bars(ticks(spark, d), "1h")))


@query("cointegration_test", f"WITH {RET_SQL}, p AS (SELECT pair, ts, ln(mid_close) AS y FROM bars), j AS (SELECT a.pair, b.pair AS other, a.ts, a.y, b.y AS x FROM p a JOIN p b ON a.ts = b.ts AND a.pair < b.pair), l AS (SELECT pair, other, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM j GROUP BY 1, 2), e AS (SELECT pair, other, ts, y - i - s * x AS e FROM j JOIN l USING (pair, other)), w AS (SELECT pair, other, e - lag(e) OVER v AS d, lag(e) OVER v AS b FROM e WINDOW v AS (PARTITION BY pair, other ORDER BY ts)), q AS (SELECT pair, other, count(*) AS n, sum(b * b) AS bb, sum(b * d) AS bd, sum(d * d) AS dd FROM w WHERE b IS NOT NULL GROUP BY 1, 2), t AS (SELECT pair, other, n, bd / bb AS reversion, (bd / bb) / sqrt((dd - bd / bb * bd) / (n - 1) / bb) AS statistic FROM q) SELECT pair, other, n, round(reversion, 5) AS reversion, round(statistic, 4) AS statistic, statistic < -3.34 AS stationary FROM t")
def cointegration_test(spark, d):
    out = K.cointegration_test(B.bars(ticks(spark, d), "1h"))
    return out.select("pair", "other", "n", F.round("reversion", 5).alias("reversion"), F.round("statistic", 4).alias("statistic"), "stationary")


@query("currency_strength", f"WITH {RET_SQL}, s AS (SELECT ts, pair[1:3] AS currency, r AS v FROM rets UNION ALL SELECT ts, pair[4:6], -r FROM rets) SELECT ts, currency, round(avg(v), 9) AS strength, count(*) AS pairs FROM s GROUP BY 1, 2")
def currency_strength(spark, d):
    return rounded(K.currency_strength(rets(spark, d)), 9)


_H = " UNION ALL ".join(f"SELECT pair, round(quantile_cont(abs(m), 0.5), 6) AS move_pips, round(any_value(s), 6) AS spread_pips, {h} AS horizon, round(quantile_cont(abs(m), 0.5) / any_value(s), 6) AS moves_per_spread FROM (SELECT pair, m, quantile_cont(s, 0.5) OVER (PARTITION BY pair) AS s FROM (SELECT pair, (lead(mid_close, {h}) OVER (PARTITION BY pair ORDER BY ts) - mid_close) / {PIP_SQL} AS m, (ask_close - bid_close) / {PIP_SQL} AS s FROM bars) WHERE m IS NOT NULL) GROUP BY pair" for h in (1, 4, 24))


@query("horizon_cost_map", f"WITH {RET_SQL} {_H}")
def horizon_cost_map(spark, d):
    return rounded(K.horizon_costs(B.bars(ticks(spark, d), "1h"), (1, 4, 24)))

