"""Queries on ticks: pairs, prices, sessions, bars, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import pairs as fx
from ..functions import text as tx
from ..operators import bars as B
from ..operators import quality as Q
from .registry import PIP_SQL, RAW_SQL, TICKS_SQL, bars_sql, local_sql, open_sql, query, raw_ticks, session_sql, ticks

QUOTE_COLUMNS = ("pair", "ts", "bid", "ask", "bid_volume", "ask_volume")


@query("ticks_projection", f"WITH {TICKS_SQL} SELECT {', '.join(QUOTE_COLUMNS)}, seq FROM ticks")
def ticks_projection(spark, d):
    return ticks(spark, d).select(*QUOTE_COLUMNS, "seq")


_VALUES = ", ".join(f"('{p}')" for p in fx.UNIVERSE)


@query(
    "pair_dim",
    f"""WITH p(pair) AS (VALUES {_VALUES}) SELECT pair, pair[1:3] AS base, pair[4:6] AS quote, pair[1:3] || '_' || pair[4:6] AS underscored,
    CASE WHEN pair[4:6] = 'JPY' THEN 3 ELSE 5 END AS digits, CASE WHEN pair[4:6] = 'JPY' THEN 1000.0::DOUBLE ELSE 100000.0::DOUBLE END AS divisor, {PIP_SQL} AS pip,
    CASE WHEN pair IN ({', '.join(repr(m) for m in fx.MAJORS)}) THEN 20.0::DOUBLE ELSE 40.0::DOUBLE END AS ceiling_pips FROM p""",
)
def pair_dim(spark, d):
    return fx.pair_dim(spark)


@query("symbol_normalise", "SELECT c_custkey, upper(replace(replace(s, '_', ''), '/', '')) AS pair, regexp_full_match(upper(replace(replace(s, '_', ''), '/', '')), '[A-Z]{6}') AS valid FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'eur_usd' WHEN 1 THEN 'GBP/usd' WHEN 2 THEN 'USDJPY' ELSE 'gold' || c_nationkey END AS s FROM customer)")
def symbol_normalise(spark, d):
    k = F.col("c_custkey") % 4
    s = F.when(k == 0, "eur_usd").when(k == 1, "GBP/usd").when(k == 2, "USDJPY").otherwise(F.concat(F.lit("gold"), F.col("c_nationkey").cast("string")))
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", s.alias("s"))
    valid = fx.is_symbol(F.col("s"))
    return c.select("c_custkey", F.when(valid, fx.normalise_symbol(F.col("s"))).otherwise(F.upper(F.regexp_replace("s", "[_/]", ""))).alias("pair"), valid.alias("valid"))


@query("price_scaling", f"WITH {TICKS_SQL} SELECT pair, count(*) AS n, min(bid) AS min_bid, max(ask) AS max_ask, min(bid_i) AS min_points, max(ask_i) AS max_points FROM ticks GROUP BY pair")
def price_scaling(spark, d):
    return ticks(spark, d).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("bid").alias("min_bid"), F.max("ask").alias("max_ask"), F.min("bid_i").alias("min_points"), F.max("ask_i").alias("max_points"))


@query("pip_spread", f"WITH {TICKS_SQL} SELECT seq, pair, (bid + ask) / 2 AS mid, round((ask - bid) / {PIP_SQL}, 6) AS pips, round((ask - bid) / 2, 9) AS half FROM ticks")
def pip_spread(spark, d):
    spread = F.col("ask") - F.col("bid")
    return ticks(spark, d).select("seq", "pair", fx.mid(F.col("bid"), F.col("ask")).alias("mid"), F.round(spread / fx.pip_size(F.col("pair")), 6).alias("pips"), F.round(spread / 2, 9).alias("half"))


@query("feed_address", f"WITH {TICKS_SQL} SELECT DISTINCT pair, hour_start, printf('%s/%04d/%02d/%02d/%02dh_ticks.bi5', pair, year(hour_start), month(hour_start) - 1, day(hour_start), hour(hour_start)) AS address, printf('%s_%s_%02dh.bi5', pair, strftime(hour_start, '%Y-%m-%d'), hour(hour_start)) AS file FROM ticks")
def feed_address(spark, d):
    h = F.col("hour_start")
    t = ticks(spark, d).select("pair", "hour_start").distinct()
    return t.select("pair", "hour_start", tx.feed_path(F.col("pair"), F.to_date(h), F.hour(h)).alias("address"), tx.hour_file(F.col("pair"), F.to_date(h), F.hour(h)).alias("file"))


@query("dates_in_text", r"SELECT o_orderkey, unnest(list_filter(list_transform(regexp_extract_all('from ' || strftime(o_orderdate, '%Y-%m-%d') || ' to 2024-13-45, then ' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d'), '\d{4}-\d{2}-\d{2}'), lambda x: TRY_CAST(x AS DATE)), lambda x: x IS NOT NULL)) AS found FROM orders")
def dates_in_text(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit("from "), day, F.lit(" to 2024-13-45, then "), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS"), "yyyy-MM-dd"))
    return o.select("o_orderkey", F.explode(tx.dates_in(text)).alias("found"))


@query("display_formats", "SELECT p_partkey, printf('%.2f', 100.0 * p_size / 50) || '%' AS share, format('{:,}', p_partkey * 1234567) AS grouped, format('{:,.2f}', p_partkey * 1234567 / 1073741824.0::DOUBLE) || ' GiB' AS size, format('{:,.1f}', p_size * 977 / 3600.0::DOUBLE) || ' h' AS hours, sha256(p_name) AS digest FROM part")
def display_formats(spark, d):
    p, n = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey") * 1234567
    return p.select("p_partkey", tx.percent(F.col("p_size"), F.lit(50)).alias("share"), tx.grouped(n).alias("grouped"), tx.gib(n).alias("size"), tx.hours(F.col("p_size") * 977).alias("hours"), tx.sha256_column(F.col("p_name")).alias("digest"))


@query("market_open_filter", f"WITH {TICKS_SQL} SELECT seq, pair, ts FROM ticks WHERE {open_sql('ts')}")
def market_open_filter(spark, d):
    return ticks(spark, d).where(cal.market_open(F.col("ts"))).select("seq", "pair", "ts")


@query("closed_market_ticks", f"WITH {TICKS_SQL} SELECT pair, ts::DATE AS date, count(*) AS closed_ticks FROM ticks WHERE NOT {open_sql('ts')} GROUP BY 1, 2")
def closed_market_ticks(spark, d):
    return ticks(spark, d).where(~cal.market_open(F.col("ts"))).groupBy("pair", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("closed_ticks"))


@query("one_sided_drop", f"WITH {RAW_SQL} SELECT pair, count(*) AS kept FROM raw WHERE bid > 0 AND ask > 0 GROUP BY pair")
def one_sided_drop(spark, d):
    from ..sources.feeds import two_sided

    return two_sided(raw_ticks(spark, d)).groupBy("pair").agg(F.count(F.lit(1)).alias("kept"))


@query("session_labels", f"WITH {TICKS_SQL} SELECT seq, {session_sql('ts')} AS session FROM ticks")
def session_labels(spark, d):
    return ticks(spark, d).select("seq", cal.session_label(F.col("ts")).alias("session"))


_LOCAL = local_sql("ts", cal.WEEK_ZONE)


@query(
    "week_bounds",
    f"""WITH {TICKS_SQL}, s AS (SELECT DISTINCT hour_start AS ts FROM ticks), l AS (SELECT ts, {_LOCAL} AS t FROM s),
    o AS (SELECT ts, t, date_trunc('day', t) - INTERVAL 1 DAY * (isodow(t) % 7) + INTERVAL 17 HOUR AS c FROM l), p AS (SELECT ts, CASE WHEN c > t THEN c - INTERVAL 7 DAY ELSE c END AS c FROM o)
    SELECT ts, timezone('UTC', timezone('America/New_York', c)) AS week_open, timezone('UTC', timezone('America/New_York', c + INTERVAL 5 DAY)) AS week_close FROM p""",
)
def week_bounds(spark, d):
    s = ticks(spark, d).select(F.col("hour_start").alias("ts")).distinct()
    return s.select("ts", cal.week_open(F.col("ts")).alias("week_open"), cal.week_close(F.col("ts")).alias("week_close"))


@query(
    "calendar_open_hours",
    f"""WITH r AS (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts FROM events)
    SELECT ts::DATE AS date, hour(ts)::INTEGER AS hour, {open_sql('ts')} AS open, ({open_sql('ts')} OR {open_sql('(ts - INTERVAL 1 HOUR)')} OR {open_sql('(ts + INTERVAL 1 HOUR)')}) AS reaches_feed FROM r""",
)
def calendar_open_hours(spark, d):
    from ..sources.requests import open_hours

    lo, hi = spark.read.parquet(f"{d}/events.parquet").agg(F.min("ts").cast("date").cast("string"), F.max("ts").cast("date").cast("string")).first()
    return open_hours(spark, lo, hi)


@query("roll_hour_exclusion", f"WITH {TICKS_SQL} SELECT pair, count(*) AS ticks FROM ticks WHERE NOT (hour({_LOCAL}) >= 16 AND hour({_LOCAL}) < 18) GROUP BY pair")
def roll_hour_exclusion(spark, d):
    from ..operators.market import without_roll

    return without_roll(ticks(spark, d)).groupBy("pair").agg(F.count(F.lit(1)).alias("ticks"))


def made(bars: DataFrame) -> DataFrame:
    return bars.withColumn("spread_mean", F.round("spread_mean", 9))


def _bars(name: str, timeframe: str) -> None:
    @query(name, f"WITH {TICKS_SQL} {bars_sql(cal.TIMEFRAMES[timeframe])}")
    def run(spark, d):
        return made(B.bars(ticks(spark, d), timeframe))


for _name, _timeframe in {"bars_1m": "1min", "bars_5m": "5min", "bars_15m": "15min", "bars_30m": "30min", "bars_1h": "1h", "bars_4h": "4h", "bars_1d": "1D"}.items():
    _bars(_name, _timeframe)


@query("bars_rollup_1m_to_1h", f"WITH {TICKS_SQL} {bars_sql(3600)}")
def bars_rollup(spark, d):
    return made(B.roll_up(B.bars(ticks(spark, d), "1min"), "1h"))


_ALL = " UNION ALL ".join(f"SELECT '{t}' AS timeframe, * FROM ({bars_sql(s)})" for t, s in cal.TIMEFRAMES.items())


@query("bars_all_timeframes", f"WITH {TICKS_SQL} {_ALL}")
def bars_all(spark, d):
    return made(B.bars_of_timeframes(ticks(spark, d), list(cal.TIMEFRAMES)))


@query("bars_rollup_equals_direct", f"WITH {TICKS_SQL} SELECT count(*) AS bars, 0::BIGINT AS differing FROM ({bars_sql(14400)})")
def bars_rollup_equals_direct(spark, d):
    t = ticks(spark, d)
    direct = B.bars(t, "4h")
    rolled = B.roll_up(B.bars(t, "1min"), "4h")
    other = rolled.select("pair", "ts", F.struct(*[c for c in rolled.columns if c not in ("pair", "ts", "spread_mean")]).alias("_o"), F.col("spread_mean").alias("_m"))
    same = (F.struct(*[c for c in direct.columns if c not in ("pair", "ts", "spread_mean")]) == F.col("_o")) & (F.abs(F.col("spread_mean") - F.col("_m")) <= 1e-12)
    return direct.join(other, ["pair", "ts"], "full").agg(F.count(F.lit(1)).alias("bars"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))


@query("bars_empty_bins", f"WITH {TICKS_SQL}, b AS (SELECT DISTINCT pair, hour_start AS ts FROM ticks), s AS (SELECT pair, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY pair) SELECT pair, ts FROM s ANTI JOIN b USING (pair, ts)")
def bars_empty_bins(spark, d):
    return B.empty_bins(B.bars(ticks(spark, d), "1h"), "1h")


@query("splice_bars", f"WITH {TICKS_SQL} {bars_sql(3600)}")
def splice_bars(spark, d):
    """Stored bars without some days' last hours, spliced with fresh bars of exactly those days."""
    full = made(B.bars(ticks(spark, d), "1h"))
    stale = full.select("pair", F.to_date("ts").alias("date")).distinct().where(F.dayofmonth("date") % 3 == 0)
    stored = full.where((F.dayofmonth("ts") % 3 != 0) | (F.hour("ts") < 12))
    return B.splice(stored, full, stale)


_VALS = "pair, hour_start, ts, bid, ask, bid_volume, ask_volume"


@query("dedup_ticks", f"WITH {RAW_SQL} SELECT {_VALS}, min(seq) AS seq FROM raw GROUP BY ALL")
def dedup_ticks(spark, d):
    return Q.dedup(raw_ticks(spark, d).select("pair", "hour_start", "ts", "bid", "ask", "bid_volume", "ask_volume", "seq"))


@query("dedup_counts_by_hour", f"WITH {RAW_SQL}, k AS (SELECT {_VALS}, count(*) AS n FROM raw GROUP BY ALL) SELECT pair, hour_start, sum(n)::BIGINT AS decoded, count(*) AS kept, (sum(n) - count(*))::BIGINT AS dropped FROM k GROUP BY 1, 2")
def dedup_counts_by_hour(spark, d):
    return Q.dedup_counts(raw_ticks(spark, d))


_REASONS = {"NON_POSITIVE_PRICE": "bid <= 0 OR ask <= 0", "CROSSED_QUOTE": "bid > ask", "CLOSED_MARKET_TICK": f"NOT {open_sql('ts')}", "TICK_OUTSIDE_HOUR": "ts < hour_start OR ts >= hour_start + INTERVAL 1 HOUR"}
_CEILING = f"(CASE WHEN pair IN ({', '.join(repr(m) for m in fx.MAJORS)}) THEN 20 ELSE 40 END)"
ISSUES_SQL = (
    " UNION ALL ".join(f"SELECT pair, hour_start, '{r}' AS reason, count(*) AS count, min(seq) AS first_seq FROM raw WHERE {p} GROUP BY pair, hour_start" for r, p in _REASONS.items())
    + f" UNION ALL SELECT pair, hour_start, 'SPREAD_OUTLIER', 1::BIGINT, NULL::BIGINT FROM raw GROUP BY pair, hour_start HAVING quantile_cont((ask - bid) / {PIP_SQL}, 0.999) > {_CEILING}"
)


@query("validate_issues_by_hour", f"WITH {RAW_SQL} {ISSUES_SQL}")
def validate_issues_by_hour(spark, d):
    return Q.issues(raw_ticks(spark, d))


@query("first_offender", f"WITH {RAW_SQL}, i AS ({ISSUES_SQL}) SELECT reason, sum(count)::BIGINT AS ticks, min(first_seq) AS first_seq FROM i WHERE reason <> 'SPREAD_OUTLIER' GROUP BY reason")
def first_offender(spark, d):
    return Q.issues(raw_ticks(spark, d)).where("reason <> 'SPREAD_OUTLIER'").groupBy("reason").agg(F.sum("count").alias("ticks"), F.min("first_seq").alias("first_seq"))


@query("rejected_hours_antijoin", f"WITH {RAW_SQL}, i AS ({ISSUES_SQL}) SELECT seq, pair, hour_start FROM raw ANTI JOIN (SELECT DISTINCT pair, hour_start FROM i WHERE reason <> 'SPREAD_OUTLIER') USING (pair, hour_start)")
def rejected_hours_antijoin(spark, d):
    raw = raw_ticks(spark, d)
    return Q.accepted(raw, Q.issues(raw)).select("seq", "pair", "hour_start")


def _stats_sql(source: str, keys: str) -> str:
    p = f"(ask - bid) / {PIP_SQL}"
    return f"SELECT {keys}, count(*) AS ticks, round(quantile_cont({p}, 0.5), 6) AS median_pips, round(avg({p}), 6) AS mean_pips, round(quantile_cont({p}, 0.99), 6) AS p99_pips, round(quantile_cont({p}, 0.999), 6) AS p99_9_pips, round(max({p}), 6) AS max_pips FROM {source} GROUP BY {keys}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("spread_stats_by_hour", f"WITH {TICKS_SQL} {_stats_sql('ticks', 'pair, hour_start')}")
def spread_stats_by_hour(spark, d):
    return _rounded(Q.spread_stats(ticks(spark, d), ["pair", "hour_start"]))


@query("spread_outlier_hours", f"WITH {TICKS_SQL}, w AS (SELECT * REPLACE (CASE WHEN seq % 211 = 0 THEN ask + 25 * {PIP_SQL} ELSE ask END AS ask) FROM ticks), s AS ({_stats_sql('w', 'pair, hour_start')}) SELECT pair, hour_start, p99_9_pips FROM s WHERE p99_9_pips > {_CEILING}")
def spread_outlier_hours(spark, d):
    wide = ticks(spark, d).withColumn("ask", F.when(F.col("seq") % 211 == 0, F.col("ask") + 25 * fx.pip_size(F.col("pair"))).otherwise(F.col("ask")))
    s = _rounded(Q.spread_stats(wide, ["pair", "hour_start"]))
    return s.where(F.col("p99_9_pips") > fx.spread_ceiling(F.col("pair"))).select("pair", "hour_start", "p99_9_pips")


@query(
    "quality_rows",
    f"""WITH {RAW_SQL}, i0 AS (SELECT {_VALS}, min(seq) AS seq, count(*) AS n FROM raw GROUP BY ALL), c AS (SELECT pair, hour_start, round(min(bid), 8) AS min_bid, round(min(ask), 8) AS min_ask,
    count(*) FILTER (bid > ask) AS crossed_ticks, count(*) FILTER (bid <= 0 OR ask <= 0) AS non_positive_ticks, sum(n)::BIGINT AS decoded, (sum(n) - count(*))::BIGINT AS dropped,
    bool_or({' OR '.join(f'({p})' for p in _REASONS.values())}) AS hard FROM i0 GROUP BY 1, 2), s AS ({_stats_sql('i0', 'pair, hour_start')})
    SELECT s.*, min_bid, min_ask, crossed_ticks, non_positive_ticks, decoded, dropped, (NOT hard AND p99_9_pips <= {_CEILING.replace('pair', 's.pair')}) AS ok FROM s JOIN c USING (pair, hour_start)""",
)
def quality_rows(spark, d):
    return _rounded(Q.quality_rows(raw_ticks(spark, d).select("pair", "hour_start", "ts", "bid", "ask", "bid_volume", "ask_volume", "seq")))


@query("out_of_order_ticks", f"WITH {TICKS_SQL}, o AS (SELECT pair, hour_start, ts < lag(ts) OVER (PARTITION BY pair, hour_start ORDER BY seq) AS back FROM ticks) SELECT pair, hour_start, count(*) FILTER (back) AS backwards FROM o GROUP BY 1, 2")
def out_of_order_ticks(spark, d):
    return Q.out_of_order(ticks(spark, d))


@query("seal_filter", f"WITH {TICKS_SQL} SELECT pair, count(*) AS ticks, max(ts) AS last_ts FROM ticks WHERE ts < TIMESTAMP '2024-01-20' GROUP BY pair")
def seal_filter(spark, d):
    import datetime

    from .research import unsealed

    return unsealed(ticks(spark, d), datetime.date(2024, 1, 20)).groupBy("pair").agg(F.count(F.lit(1)).alias("ticks"), F.max("ts").alias("last_ts"))


