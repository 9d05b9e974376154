"""A query is a function of (spark, sf_dir) and, where SQL can express it, SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..session import pin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Which pair an event type stands for.
PAIR_OF = {"click": "EURUSD", "view": "GBPUSD", "purchase": "USDJPY", "signup": "USDCHF"}
OTHER_PAIR = "EURJPY"
PAIRS = (*PAIR_OF.values(), OTHER_PAIR)
COPY = 10_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin(spark)
            out = f(spark, sf_dir)
            return out.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in out.dtypes])

        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as quotes: prices in points first, then divided once by the pair's divisor."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pair = F.lit(OTHER_PAIR)
    for kind, name in PAIR_OF.items():
        pair = F.when(F.col("event_type") == kind, name).otherwise(pair)
    t = e.select(
        pair.alias("pair"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.floor(F.col("value") * 100 + 0.5) + 100_000).cast("long").alias("bid_i"),
        (F.col("event_id") % 9 + 1).alias("_s"), (F.col("event_id") % 7 + 1).cast("double").alias("bid_volume"), (F.col("user_id") % 11 + 1).cast("double").alias("ask_volume"),
    )
    t = t.withColumn("ask_i", F.col("bid_i") + F.col("_s")).drop("_s")
    return _priced(t).withColumn("hour_start", F.date_trunc("hour", "ts"))


def _priced(t: DataFrame) -> DataFrame:
    from ..functions.pairs import divisor

    return t.withColumns({"bid": F.col("bid_i") / divisor(F.col("pair")), "ask": F.col("ask_i") / divisor(F.col("pair"))})


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes with planted defects: crossed and zero prices, ticks filed under another hour, repeated records."""
    t = ticks(spark, sf_dir)
    s = F.col("seq")
    t = t.withColumn("bid_i", F.when(s % 997 == 0, F.col("ask_i") + 50).when(s % 1499 == 0, F.lit(0)).otherwise(F.col("bid_i")))
    t = _priced(t).withColumn("hour_start", F.when(s % 1009 == 0, F.col("hour_start") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("hour_start")))
    return t.unionByName(t.where(s % 50 < 3).withColumn("seq", s + COPY))


def local_sql(ts: str, zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', {ts}))"


def open_sql(ts: str) -> str:
    t = local_sql(ts, cal.WEEK_ZONE)
    return f"(NOT (isodow({t}) = 6 OR (isodow({t}) = 7 AND hour({t}) < {cal.WEEK_HOUR}) OR (isodow({t}) = 5 AND hour({t}) >= {cal.WEEK_HOUR})))"


def session_sql(ts: str) -> str:
    on = {}
    for name, zone, a, b in cal.WINDOWS:
        t = local_sql(ts, zone)
        on[name] = f"(isodow({t}) <= 5 AND hour({t}) >= {a} AND hour({t}) < {b})"
    return f"CASE WHEN {on['london']} AND {on['new_york']} THEN '{cal.OVERLAP}' WHEN {on['london']} THEN 'london' WHEN {on['new_york']} THEN 'new_york' WHEN {on['tokyo']} THEN 'tokyo' ELSE '{cal.OTHER}' END"


DIVISOR_SQL = "(CASE WHEN pair[4:6] = 'JPY' THEN 1000.0::DOUBLE ELSE 100000.0::DOUBLE END)"
PIP_SQL = "(CASE WHEN pair[4:6] = 'JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END)"
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PAIR_OF.items()) + f" ELSE '{OTHER_PAIR}' END"
TICKS_SQL = f"""
points AS (SELECT {_CASE} AS pair, ts, event_id AS seq, CAST(floor(value * 100 + 0.5) AS BIGINT) + 100000 AS bid_i,
  CAST(floor(value * 100 + 0.5) AS BIGINT) + 100000 + event_id % 9 + 1 AS ask_i, (event_id % 7 + 1)::DOUBLE AS bid_volume, (user_id % 11 + 1)::DOUBLE AS ask_volume FROM events),
ticks AS (SELECT *, bid_i / {DIVISOR_SQL} AS bid, ask_i / {DIVISOR_SQL} AS ask, date_trunc('hour', ts) AS hour_start FROM points)"""
RAW_SQL = f"""{TICKS_SQL},
spoilt AS (SELECT * REPLACE (CASE WHEN seq % 997 = 0 THEN ask_i + 50 WHEN seq % 1499 = 0 THEN 0 ELSE bid_i END AS bid_i,
  CASE WHEN seq % 1009 = 0 THEN hour_start - INTERVAL 1 HOUR ELSE hour_start END AS hour_start) FROM ticks),
respoilt AS (SELECT * REPLACE (bid_i / {DIVISOR_SQL} AS bid) FROM spoilt),
raw AS (SELECT * FROM respoilt UNION ALL SELECT * REPLACE (seq + {COPY} AS seq) FROM respoilt WHERE seq % 50 < 3)"""
KEY_SQL = "epoch_us(ts)::HUGEINT * 18446744073709551616::HUGEINT + seq"


def bars_sql(seconds: int, source: str = "ticks", places: int = 9) -> str:
    w = seconds * 1_000_000
    k = KEY_SQL
    cols = []
    for q in ("bid", "ask", "mid"):
        x = "(bid + ask) / 2" if q == "mid" else q
        cols += [f"arg_min({x}, {k}) AS {q}_open", f"max({x}) AS {q}_high", f"min({x}) AS {q}_low", f"arg_max({x}, {k}) AS {q}_close"]
    return f"SELECT pair, make_timestamp((epoch_us(ts) // {w}) * {w}) AS ts, {', '.join(cols)}, count(*) AS tick_count, round(avg(ask - bid), {places}) AS spread_mean, max(ask - bid) AS spread_max FROM {source} GROUP BY 1, 2"
