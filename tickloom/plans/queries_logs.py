"""Queries on generated files: hour files, candles, ledgers, sessions, the store, and streams.

Inputs are written below the session's shared folder and read back through the
sources.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import bi5, control, logs, quotes, requests, store
from ..sources.feeds import two_sided
from ..session import shared_dir, ship_package
from ..streaming.live import recorder, stream_bars
from . import incremental
from .ingest import still_pending
from .queries_ticks import made
from .registry import TICKS_SQL, bars_sql, open_sql, query, ticks


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"


@query(
    "candle_parse",
    f"""WITH {TICKS_SQL}, bars AS ({bars_sql(3600)}) SELECT pair, ts, hour(ts) % 5 <> 0 AS complete, tick_count AS volume, round(bid_open, 5) AS bid_open, round(ask_close, 5) AS ask_close, round(mid_high, 6) AS mid_high FROM bars""",
)
def candle_parse(spark, d):
    """Bars rendered as a source's JSON answers, with string prices and nanosecond times, and parsed again."""
    b = B.bars(ticks(spark, d), "1h")

    def quote(q: str):
        places = "%.6f" if q == "mid" else "%.5f"
        return F.struct(*[F.format_string(places, F.col(f"{q}_{long}")).alias(short) for short, long in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))]).alias(q)

    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000000Z")).alias("time")
    one = F.struct(time, (F.hour("ts") % 5 != 0).alias("complete"), F.col("tick_count").alias("volume"), quote("bid"), quote("ask"), quote("mid"))
    document = F.to_json(F.struct(F.concat(F.substring("pair", 1, 3), F.lit("_"), F.substring("pair", 4, 3)).alias("instrument"), F.lit("H1").alias("granularity"), F.array(one).alias("candles")))
    parsed = b.select(F.from_json(document, logs.CANDLES.struct).alias("d")).select("d.*")
    return logs.candles(parsed).select("pair", "ts", "complete", "volume", "bid_open", "ask_close", "mid_high")


_LEDGER = "e AS (SELECT o_orderkey AS k, printf('E-%d', o_custkey) AS experiment_id, printf('T%d', o_custkey % 7) AS taskcard, o_orderdate AS made FROM orders)"


def ledger_rows(spark, d) -> DataFrame:
    """Orders as ledger records: a start for every order, an end for most, a few of them too early."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    when = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    later = F.date_format(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderdate") - F.expr("INTERVAL 4000 DAYS")).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")), "yyyy-MM-dd'T'HH:mm:ss")
    name, none = F.format_string("E-%d", "o_custkey"), F.lit(None).cast("string")
    start = o.select(F.lit("start").alias("record"), name.alias("experiment_id"), F.format_string("T%d", F.col("o_custkey") % 7).alias("taskcard"), when.alias("started_at"), none.alias("ended_at"), none.alias("status"))
    status = F.format_string('ok {"completed": %d, "throttles": %d, "seconds": %d.5}', F.col("o_orderkey"), F.col("o_orderkey") % 3, F.col("o_orderkey") % 100)
    end = o.where("o_orderkey % 3 <> 0").select(F.lit("end").alias("record"), name.alias("experiment_id"), none.alias("taskcard"), none.alias("started_at"), later.alias("ended_at"), status.alias("status"))
    return start.unionByName(end)


@query("ledger_trials", f"WITH {_LEDGER} SELECT taskcard, count(*) AS trials FROM e GROUP BY 1")
def ledger_trials(spark, d):
    path = scratch(spark) + "/ledger"
    logs.write_lines(ledger_rows(spark, d), path)
    return logs.trials(logs.read_ledger(spark, path))


@query("ledger_ordering_violations", f"WITH {_LEDGER}, f AS (SELECT experiment_id, min(made) AS first_start FROM e GROUP BY 1), n AS (SELECT experiment_id, CASE WHEN k % 50 = 0 THEN made - INTERVAL 4000 DAY ELSE made + INTERVAL 1 DAY END AS ended FROM e WHERE k % 3 <> 0) SELECT experiment_id, strftime(ended, '%Y-%m-%dT%H:%M:%S') AS ended_at, strftime(first_start, '%Y-%m-%dT%H:%M:%S') AS first_start FROM n JOIN f USING (experiment_id) WHERE ended < first_start")
def ledger_ordering_violations(spark, d):
    return logs.ordering_violations(ledger_rows(spark, d))


@query("ledger_costs", f"WITH {_LEDGER} SELECT experiment_id, count(*) AS sessions, sum(k)::BIGINT AS probes, sum(k % 3)::BIGINT AS throttles, sum(k % 100 + 0.5::DOUBLE) AS seconds, 0.0::DOUBLE AS parked, 0::BIGINT AS outages FROM e WHERE k % 3 <> 0 GROUP BY 1")
def ledger_costs(spark, d):
    return logs.harvest_costs(ledger_rows(spark, d))


@query("throughput_by_level", "WITH w AS (SELECT (o_custkey % 4 + 1)::INTEGER AS level, o_orderkey % 500 + 1 AS requests, (o_orderkey % 90 + 1)::DOUBLE AS seconds, o_orderkey % 5 AS throttles FROM orders) SELECT level, sum(requests)::BIGINT AS requests, sum(seconds) AS seconds, sum(throttles)::BIGINT AS throttles, round(sum(requests) / sum(seconds), 6) AS requests_per_second, round(sum(throttles) / sum(requests), 6) AS throttle_rate FROM w GROUP BY level")
def throughput_by_level(spark, d):
    k = F.col("o_orderkey")
    w = F.struct((F.col("o_custkey") % 4 + 1).cast("int").alias("level"), F.lit(0.0).alias("rate"), (k % 500 + 1).alias("requests"), (k % 90 + 1).cast("double").alias("seconds"), (k % 5).alias("throttles"))
    s = spark.read.parquet(f"{d}/orders.parquet").select(F.struct(F.array(w).alias("windows")).alias("calibration"))
    path = scratch(spark) + "/sessions"
    logs.write_lines(s, path)
    return logs.throughput(logs.read_sessions(spark, path))


_REPLAY = """WITH RECURSIVE numbered AS (SELECT o_custkey % 20 AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS n FROM orders),
w AS (SELECT printf('S-%d', k) AS session, n, n * 600.0::DOUBLE AS ended, (CASE WHEN (n // (5 + k)) % 3 = 2 THEN 17 + o % 30 ELSE o % 9 END) / (100 + o % 40)::DOUBLE AS share FROM numbered),
walk(session, n, ended, share, tolerance, level, next_level, decision, clean, bad, s2, s3, s3_shut, s4_shut) AS (
  SELECT DISTINCT session, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 2, 2, 'start', 0::DOUBLE, 0, NULL::DOUBLE, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM w
  UNION ALL
  SELECT session, n, ended, share, tolerance, level, CASE decision WHEN 'up' THEN level + 1 WHEN 'down' THEN greatest(2, level - 1) ELSE level END, decision,
    CASE WHEN decision IN ('up', 'down') THEN ended ELSE clean END, CASE WHEN decision = 'bad' THEN bad + 1 ELSE 0 END,
    CASE WHEN decision IN ('up', 'stay') AND level = 2 THEN (coalesce(s2, share) + share) / 2 ELSE s2 END,
    CASE WHEN decision IN ('up', 'stay') AND level = 3 THEN (coalesce(s3, share) + share) / 2 ELSE s3 END,
    CASE WHEN decision = 'down' AND level <= 3 THEN ended + 21600 ELSE s3_shut END, CASE WHEN decision = 'down' AND level = 4 THEN ended + 21600 ELSE s4_shut END
  FROM (SELECT *, CASE WHEN share > tolerance THEN CASE WHEN bad = 1 THEN 'down' ELSE 'bad' END
      WHEN level < 4 AND ended - clean >= 3600 AND ended >= (CASE level WHEN 2 THEN s3_shut ELSE s4_shut END) THEN 'up' ELSE 'stay' END AS decision
    FROM (SELECT w.*, s.next_level AS level, clean, bad, s2, s3, s3_shut, s4_shut,
        coalesce(least(0.1::DOUBLE, CASE s.next_level WHEN 3 THEN greatest(s2 * 1.5::DOUBLE, s2 + 0.02::DOUBLE) WHEN 4 THEN greatest(s3 * 1.5::DOUBLE, s3 + 0.02::DOUBLE) END), 0.1::DOUBLE) AS tolerance
      FROM walk s JOIN w ON w.session = s.session AND w.n = s.n + 1)))
SELECT session, n::INTEGER AS n, round(share, 9) AS share, round(tolerance, 9) AS tolerance, level, next_level, decision FROM walk WHERE n > 0"""


@query("level_replay", _REPLAY)
def level_replay(spark, d):
    """Orders as the windows of sessions, with stretches of throttled ones, and the level that follows from them."""
    k, o = F.col("o_custkey") % 20, F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("k").orderBy("o"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), o.alias("o")).withColumn("n", n)
    busy = F.expr("(n div (5 + k)) % 3 = 2")
    windows = rows.select(F.format_string("S-%d", "k").alias("session"), "n", (F.col("n") * 600.0).alias("at"), (100 + F.col("o") % 40).alias("requests"), F.when(busy, 17 + F.col("o") % 30).otherwise(F.col("o") % 9).alias("throttles"))
    out = control.replay_levels(windows)
    return out.select("session", "n", F.round("share", 9).alias("share"), F.round("tolerance", 9).alias("tolerance"), "level", "next_level", "decision")


@query("pair_months", "WITH r(pair, a, b) AS (VALUES ('EURUSD', DATE '2023-11-15', DATE '2024-02-10'), ('USDJPY', DATE '2024-01-01', DATE '2024-01-31')), m AS (SELECT pair, a, b, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM r) SELECT pair, year(m)::INTEGER AS year, month(m)::INTEGER AS month, greatest(a, m) AS first, least(b, last_day(m)) AS last FROM m")
def pair_months(spark, d):
    return requests.pair_months(spark, [("EURUSD", "2023-11-15", "2024-02-10"), ("USDJPY", "2024-01-01", "2024-01-31")])


@query("expected_hours", f"WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2023-03-01', TIMESTAMP '2024-03-31 23:00:00', INTERVAL 1 HOUR)) AS ts) SELECT year(ts)::INTEGER AS year, count(*) AS hours FROM h WHERE {open_sql('ts')} GROUP BY 1")
def expected_hours(spark, d):
    return requests.expected_hours(spark, "2023-03-01", "2024-03-31")


@query("probe_plan", f"WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS date), p(pair) AS (VALUES ('EURUSD'), ('USDJPY')) SELECT pair, date, 13 AS hour FROM d, p WHERE {open_sql('(date::TIMESTAMP + INTERVAL 13 HOUR)')} AND NOT (pair = 'USDJPY' AND day(date) < 10)")
def probe_plan(spark, d):
    days = requests.trading_days(spark, "2024-01-01", "2024-01-31", 13)
    done = requests.pair_calendar(spark, ["USDJPY"], days.where("dayofmonth(date) < 10")).withColumn("hour", F.lit(13))
    return requests.probe_plan(spark, ["EURUSD", "USDJPY"], days, 13, done)


@query("hour_files_decode", f"WITH {TICKS_SQL} SELECT pair, hour_start, count(*) AS ticks, round(min(bid), 5) AS min_bid, round(max(ask), 5) AS max_ask, sum(bid_volume) AS bid_volume FROM ticks GROUP BY 1, 2")
def hour_files_decode(spark, d):
    """All ticks encoded as compressed hour files on the executors, and decoded again."""
    import pandas as pd

    few = ticks(spark, d).select("pair", "hour_start", "seq", ((F.unix_micros("ts") - F.unix_micros("hour_start")) / 1000).cast("long").alias("ms"), "bid_i", "ask_i", "bid_volume", "ask_volume")
    ship_package(spark)

    def encode(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g, r = g.sort_values("seq"), np.zeros(len(g), bi5.RECORD)
        r["ms"], r["ask"], r["bid"], r["ask_volume"], r["bid_volume"] = g.ms, g.ask_i, g.bid_i, g.ask_volume, g.bid_volume
        hour = g.hour_start.iloc[0]
        return pd.DataFrame({"path": [f"{g.pair.iloc[0]}_{hour:%Y-%m-%d}_{hour:%H}h.bi5"], "content": [bi5.encode_hour(r)]})

    files = few.groupBy("pair", "hour_start").applyInPandas(encode, "path string, content binary")
    t = bi5.scale(bi5.decode_files(files)).where("seq is not null")
    return t.groupBy("pair", "hour_start").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.min("bid"), 5).alias("min_bid"), F.round(F.max("ask"), 5).alias("max_ask"), F.sum("bid_volume").alias("bid_volume"))


def stored(spark, d) -> str:
    root = scratch(spark)
    store.write_ticks(ticks(spark, d).withColumn("source", F.lit("events")), root)
    return root


@query("store_scan", f"WITH {TICKS_SQL} SELECT pair, ts::DATE AS date, count(*) AS ticks, min(bid) AS min_bid FROM ticks WHERE pair IN ('EURUSD', 'USDJPY') AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1, 2")
def store_scan(spark, d):
    t = store.read_ticks(spark, stored(spark, d), ["EURUSD", "USDJPY"], "2024-01-05", "2024-01-12")
    return t.groupBy("pair", "date").agg(F.count(F.lit(1)).alias("ticks"), F.min("bid").alias("min_bid"))


@query("store_footprint", f"WITH {TICKS_SQL} SELECT pair, count(DISTINCT hour_start) AS files, true AS has_bytes, count(DISTINCT ts::DATE) AS days FROM ticks GROUP BY pair")
def store_footprint(spark, d):
    """Files, one for each hour; what they weigh is up to the codec."""
    return store.footprint(store.files(spark, stored(spark, d) + "/ticks")).select("pair", "files", (F.col("bytes") > 0).alias("has_bytes"), "days")


_HOURS = "h AS (SELECT pair, ts::DATE AS date, hour(ts)::INTEGER AS hour, count(*) AS n FROM ticks GROUP BY ALL)"


@query("store_listing", f"WITH {TICKS_SQL}, {_HOURS} SELECT pair, date, hour FROM h")
def store_listing(spark, d):
    """Hours that the names of the store's files show, without reading them."""
    return store.listing(store.files(spark, stored(spark, d) + "/ticks"))


@query("half_days", f"WITH {TICKS_SQL}, {_HOURS} SELECT pair, date, hour, n AS ticks FROM h")
def half_days(spark, d):
    """The store after the mornings were written, then the afternoons, then one hour of each day again."""
    root, t = scratch(spark), ticks(spark, d).withColumn("source", F.lit("events"))
    for part in ("hour(ts) < 12", "hour(ts) >= 12", "hour(ts) = 7"):
        store.write_ticks(t.where(part), root)
    return store.read_ticks(spark, root).groupBy("pair", "date", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("ticks"))


@query("manifest_merge", f"WITH {TICKS_SQL}, {_HOURS} SELECT pair, date, hour, CASE WHEN hour % 6 = 0 THEN 'gap' ELSE 'ok' END AS status, CASE WHEN hour % 6 = 0 THEN 0 ELSE n END AS written_ticks FROM h")
def manifest_merge(spark, d):
    """A stored manifest after the mornings, the afternoons, and then every sixth hour again as a gap."""
    path = scratch(spark) + "/manifest"
    h = ticks(spark, d).groupBy("pair", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("written_ticks")).withColumn("status", F.lit("ok"))
    store.write_manifest(h.where("hour < 12"), path)
    store.write_manifest(h.where("hour >= 12"), path)
    store.write_manifest(h.where("hour % 6 = 0").withColumns({"status": F.lit("gap"), "written_ticks": F.lit(0).cast("long")}), path)
    return store.read_stored_manifest(spark, path).select("pair", "date", "hour", "status", "written_ticks")


@query("resume_by_files", f"WITH {TICKS_SQL}, {_HOURS} SELECT pair, date, hour FROM h WHERE hour >= 12 AND hour % 5 <> 0 OR hour = 3")
def resume_by_files(spark, d):
    """What is left to ask for after the mornings are stored, when a file is lost and some afternoons are settled as empty."""
    root = scratch(spark)
    t = ticks(spark, d).withColumn("source", F.lit("events"))
    h = t.groupBy("pair", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("written_ticks"))
    store.write_ticks(t.where("hour(ts) < 12 and hour(ts) <> 3"), root)
    store.write_manifest(h.where("hour < 12").withColumn("status", F.lit("ok")), f"{root}/manifest")
    store.write_manifest(h.where("hour >= 12 and hour % 5 = 0").withColumn("status", F.lit("empty")), f"{root}/manifest")
    return still_pending(spark, h.select("pair", "date", "hour"), root, f"{root}/manifest")


@query("incremental_bars", f"WITH {TICKS_SQL} {bars_sql(3600)}")
def incremental_bars(spark, d):
    """Bars built in two steps: a part of the days first, then the whole store."""
    root = scratch(spark)
    t = ticks(spark, d).withColumn("source", F.lit("events"))
    store.write_ticks(t.where("dayofmonth(ts) <= 20"), root)
    incremental.build_bars(spark, root, ["1h", "1D"])
    store.write_ticks(t.where("dayofmonth(ts) >= 18"), root)
    incremental.build_bars(spark, root, ["1h", "1D"])
    return made(store.read_bars(spark, root, "1h"))


@query("stream_bars", f"WITH {TICKS_SQL} {bars_sql(3600)}")
def streamed(spark, d):
    """Bars of a stream of files, run to its end; a late tick of another pair closes the last bars and is left out."""
    root = scratch(spark)
    t = ticks(spark, d)
    t.repartitionByRange(4, "ts").write.parquet(f"{root}/in")
    closing = t.agg(F.max("ts").alias("_end")).join(t.limit(1)).withColumns({"pair": F.lit("ZZZZZZ"), "ts": F.col("_end") + F.expr("INTERVAL 1 DAY")})
    closing.select(*t.columns).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    writer = stream_bars(source, "1h").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return made(spark.read.parquet(f"{root}/out").where("pair <> 'ZZZZZZ'"))


@query("recorded_ticks", f"WITH {TICKS_SQL} SELECT pair, ts::DATE AS date, count(*) AS ticks FROM ticks GROUP BY 1, 2")
def recorded(spark, d):
    """A stream of quotes through the recorder."""
    root = scratch(spark)
    ticks(spark, d).withColumn("source", F.lit("live")).write.parquet(f"{root}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    recorder(source, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("pair", F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("ticks"))


@query("live_bars", f"WITH {TICKS_SQL}, sent AS (SELECT * FROM ticks WHERE seq % 10 <> 0) {bars_sql(3600, 'sent')}")
def live_bars(spark, d):
    """Every tenth quote sent with one side only; the spool read as a stream, recorded, and made into bars."""
    root = scratch(spark)
    folder = f"{root}/spool".removeprefix("file://").removeprefix("file:")
    ship_package(spark)

    def spool(batches):
        import pandas as pd

        begun: set[str] = set()
        for b in batches:
            for pair, g in b.groupby("pair", sort=False):
                if pair not in begun:  # a task that is run again starts its pairs anew
                    begun.add(pair)
                    Path(folder, f"{pair}.quotes").unlink(missing_ok=True)
                ask = g.ask.where(g.seq % 10 != 0, 0.0)
                n = quotes.Spool(folder).append(pair, zip(g.us, g.bid, ask, g.bid_volume, g.ask_volume, strict=True))
                yield pd.DataFrame({"pair": [pair], "n": [n]})

    t = ticks(spark, d).select("pair", F.unix_micros("ts").alias("us"), "bid", "ask", "bid_volume", "ask_volume", "seq")
    t.repartition("pair").sortWithinPartitions("pair", "us", "seq").mapInPandas(spool, "pair string, n long").write.parquet(f"{root}/spooled")
    pairs = [r["pair"] for r in spark.read.parquet(f"{root}/spooled").select("pair").distinct().collect()]
    live = quotes.live_quotes(spark, folder, pairs)
    recorder(live, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    kept = two_sided(spark.read.parquet(f"{root}/out").select("pair", F.col("ts"), "bid", "ask"))
    return made(B.bars(kept, "1h", None))
