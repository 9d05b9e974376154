"""Hour files, ingestion, the store, incremental bars, streams, settings and the ledger."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.functions import text as tx
from tickloom.operators import bars as B
from tickloom.operators import coverage as V
from tickloom.operators import reports as R
from tickloom.plans import incremental, research
from tickloom.plans.ingest import ingest
from tickloom.schemas import MANIFEST_HOURS, TICKS, SchemaError, require
from tickloom.sources import bi5, config, feeds, logs, requests, store
from tickloom.streaming.live import recorder, sorted_recorder, stream_bars

UTC = datetime.UTC


def hour(n=90, seed=0, base=110_000):
    rng = np.random.default_rng(seed)
    r = np.zeros(n, bi5.RECORD)
    r["ms"] = np.arange(n) * (3_600_000 // n)
    r["bid"] = base + np.cumsum(rng.integers(-3, 4, n))
    r["ask"] = r["bid"] + 8
    r["bid_volume"], r["ask_volume"] = 1.8, 2.5
    return r


@pytest.fixture
def folder(tmp_path):
    good, crossed, zero, twice = hour(), hour(seed=1), hour(seed=2), hour(seed=3)
    crossed["bid"][40] = crossed["ask"][40] + 50
    zero["bid"][7] = 0
    late = hour(seed=4)
    late["ms"][-1] = 3_600_001
    files = {
        "EURUSD_2026-07-14_12h": bi5.encode_hour(good), "EURUSD_2026-07-14_13h": bi5.encode_hour(crossed), "EURUSD_2026-07-14_14h": bi5.encode_hour(zero),
        "EURUSD_2026-07-14_15h": bi5.encode_hour(np.concatenate([twice[:20], twice[10:20], twice[20:]])), "EURUSD_2026-07-14_16h": b"", "EURUSD_2026-07-11_13h": bi5.encode_hour(good),
        "EURUSD_2026-07-11_14h": b"", "EURUSD_2026-07-14_17h": b"no lzma", "EURUSD_2026-07-14_18h": bi5.encode_hour(late), "USDJPY_2026-07-14_12h": bi5.encode_hour(hour(base=150_000)),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.bi5").write_bytes(content)
    return tmp_path


def test_ingest(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    asked = requests.request_grid(spark, ["EURUSD"], "2026-07-14", "2026-07-14", (12, 13, 14, 15, 16, 17, 18, 19)).unionByName(requests.request_grid(spark, ["EURUSD"], "2026-07-11", "2026-07-11", (13, 14))).unionByName(requests.request_grid(spark, ["USDJPY"], "2026-07-14", "2026-07-14", (12,)))
    m = {(r.pair, r.date.day, r.hour): r for r in ingest(spark, str(folder), asked, out).collect()}
    assert len(m) == 11
    status = {k: v.status for k, v in m.items()}
    assert status == {("EURUSD", 14, 12): "ok", ("EURUSD", 14, 13): "gap", ("EURUSD", 14, 14): "gap", ("EURUSD", 14, 15): "ok", ("EURUSD", 14, 16): "empty", ("EURUSD", 14, 17): "gap", ("EURUSD", 14, 18): "gap", ("EURUSD", 14, 19): "gap", ("EURUSD", 11, 13): "gap", ("EURUSD", 11, 14): "closed", ("USDJPY", 14, 12): "ok"}
    reasons = {k: {i.reason for i in v.issues} for k, v in m.items()}
    assert reasons["EURUSD", 14, 13] == {"CROSSED_QUOTE"}
    assert reasons["EURUSD", 14, 14] == {"NON_POSITIVE_PRICE", "SPREAD_OUTLIER"}
    assert "CLOSED_MARKET_TICK" in reasons["EURUSD", 11, 13]
    assert reasons["EURUSD", 14, 17] == {"DECODE_ERROR"}
    assert reasons["EURUSD", 14, 18] == {"TICK_OUTSIDE_HOUR"}
    assert reasons["EURUSD", 14, 19] == {"FETCH_ERROR"}
    assert reasons["EURUSD", 14, 16] == {"EMPTY_TRADING_HOUR"}
    assert (m["EURUSD", 14, 15].duplicates_dropped, m["EURUSD", 14, 15].written_ticks) == (10, 90)
    assert m["EURUSD", 14, 16].sha256 == tx.EMPTY_SHA256
    ticks = store.read_ticks(spark, out, ["USDJPY"])
    row = ticks.orderBy("ts").first()
    assert ticks.count() == 90
    assert (row.bid, row.bid_volume) == (pytest.approx(150.0, abs=0.01), 1.7999999523162842)
    require(ticks.select(*TICKS.names), TICKS)
    assert store.listing(store.files(spark, f"{out}/ticks")).count() == store.hours_present(store.read_ticks(spark, out)).count() > 0
    assert {r.pair: r.days for r in store.footprint(store.files(spark, f"{out}/ticks")).collect()} == {"EURUSD": 1, "USDJPY": 1}


def test_data_source_and_availability(spark, folder):
    spark.dataSource.register(bi5.Bi5DataSource)
    df = spark.read.format("bi5").load(str(folder))
    assert df.where("seq is not null").count() == 7 * 90 + 10
    assert df.where("error is not null").select("hour").collect()[0][0] == 17
    files = bi5.hour_files(spark, str(folder))
    asked = requests.request_grid(spark, ["EURUSD"], "2026-07-14", "2026-07-14", (12, 16, 20))
    assert {r.hour: r.availability for r in bi5.availability(asked, files).collect()} == {12: "present", 16: "empty", 20: "missing"}


def test_decode_errors():
    with pytest.raises(bi5.DecodeError, match="whole records"):
        bi5.decode_records(b"x" * 21)
    with pytest.raises(bi5.DecodeError, match="LZMA"):
        bi5.decompress(b"\x00\x01")
    assert bi5.decompress(b"") == b""


def test_incremental_bars(spark, tmp_path):
    root = str(tmp_path)

    def day(d, pair="EURUSD", up=0.0):
        rows = [(pair, datetime.datetime(2026, 7, d, h, m, tzinfo=UTC), 1.1 + h / 1000 + up, 1.1002 + h / 1000 + up, 1.0, 1.0, "t") for h in range(24) for m in (0, 30)]
        return spark.createDataFrame(rows, TICKS)

    store.write_ticks(day(14).unionByName(day(15)), root)
    assert incremental.build_bars(spark, root, ["1h", "1D"]).count() == 4
    assert store.read_bars(spark, root, "1h").count() == 48
    assert incremental.build_bars(spark, root, ["1h", "1D"]).count() == 0
    assert incremental.build_bars(spark, root, ["4h"]).count() == 2  # another timeframe has its own stale days
    store.write_ticks(day(15, up=0.5).unionByName(day(16)), root)
    incremental.build_bars(spark, root, ["1h", "1D", "4h"])
    assert store.read_bars(spark, root, "1h").count() == 72  # no day is stored twice
    assert store.read_bars(spark, root, "1D").where("dayofmonth(ts) = 15").first().bid_open == pytest.approx(1.6)
    import shutil

    shutil.rmtree(f"{root}/ticks/pair=EURUSD/date=2026-07-14")
    built = incremental.build_bars(spark, root, ["1h", "1D", "4h"])
    assert {r.gone for r in built.collect()} == {True}
    assert store.read_bars(spark, root, "1h").count() == 48  # a day whose files are gone loses its bars
    with pytest.raises(LookupError):
        store.read_bars(spark, root, "5min")


def test_empty_store(spark, tmp_path):
    assert store.read_ticks(spark, str(tmp_path)).count() == 0


def test_splice_touches_only_stale_days(spark):
    def at(d, n):
        return [("EURUSD", datetime.datetime(2026, 7, d, h, tzinfo=UTC), n) for h in range(3)]

    schema = "pair string, ts timestamp, n int"
    stored, fresh = spark.createDataFrame(at(14, 1) + at(15, 1), schema), spark.createDataFrame(at(14, 2) + at(15, 2), schema)
    stale = spark.createDataFrame([("EURUSD", datetime.date(2026, 7, 15)), ("EURUSD", datetime.date(2026, 7, 16))], "pair string, date date")
    got = B.splice(stored, fresh, stale).groupBy(F.dayofmonth("ts").alias("d")).agg(F.count("*").alias("c"), F.max("n").alias("n")).collect()
    assert {r.d: (r.c, r.n) for r in got} == {14: (3, 1), 15: (3, 2)}


def test_bar_edges_and_ties(spark):
    t0 = datetime.datetime(2026, 7, 14, 13, tzinfo=UTC)
    rows = [("EURUSD", t0, 1.0, 1.2, 0), ("EURUSD", t0 + datetime.timedelta(seconds=60), 2.0, 2.2, 1), ("EURUSD", t0 + datetime.timedelta(seconds=60), 5.0, 5.2, 2), ("EURUSD", t0 + datetime.timedelta(seconds=240), 3.0, 3.2, 3)]
    made = B.bars(spark.createDataFrame(rows, "pair string, ts timestamp, bid double, ask double, seq long"), "1min")
    got = {r.ts.replace(tzinfo=UTC).minute: (r.bid_open, r.bid_close, r.tick_count) for r in made.collect()}
    assert got == {0: (1.0, 1.0, 1), 1: (2.0, 5.0, 2), 4: (3.0, 3.0, 1)}
    assert sorted(r.ts.minute for r in B.empty_bins(made, "1min").collect()) == [2, 3]


@pytest.mark.parametrize(
    ("at", "open_", "session"),
    [("2026-07-17 20:59:59.803", True, None), ("2026-07-17 21:00:00", False, None), ("2026-07-19 21:00:03.426", True, None), ("2026-01-09 21:00:00", True, None), ("2026-01-09 22:00:00", False, None),
     ("2026-07-14 02:00:00", True, "tokyo"), ("2026-07-14 13:00:00", True, "london_ny_overlap"), ("2026-07-14 18:00:00", True, "new_york"), ("2026-07-14 23:00:00", True, "sydney"), ("2026-07-11 13:00:00", False, "sydney"),
     ("2026-03-17 12:30:00", True, "london_ny_overlap"), ("2026-10-28 12:30:00", True, "london_ny_overlap")],
)
def test_week_and_sessions(spark, at, open_, session):
    r = spark.sql(f"select timestamp'{at}' as ts").select(cal.market_open(F.col("ts")), cal.session_label(F.col("ts"))).first()
    assert r[0] == open_
    assert session in (None, r[1])


@pytest.mark.parametrize(("at", "lo", "hi"), [("2026-07-14 12:00:00", "2026-07-12 21", "2026-07-17 21"), ("2026-01-07 12:00:00", "2026-01-04 22", "2026-01-09 22"), ("2026-03-10 00:00:00", "2026-03-08 21", "2026-03-13 21"), ("2026-07-12 20:59:59", "2026-07-05 21", "2026-07-10 21")])
def test_week_bounds(spark, at, lo, hi):
    r = spark.sql(f"select timestamp'{at}' as ts").select(F.date_format(cal.week_open(F.col("ts")), "yyyy-MM-dd HH"), F.date_format(cal.week_close(F.col("ts")), "yyyy-MM-dd HH")).first()
    assert tuple(r) == (lo, hi)


def test_timeframes():
    assert [cal.timeframe(x) for x in ("5m", "60min", "1h", "h", "1d", "24h", "15T")] == ["5min", "1h", "1h", "1h", "1D", "1D", "15min"]
    with pytest.raises(cal.TimeframeError):
        cal.timeframe("7min")


def series(spark, kinds):
    return spark.createDataFrame([("EURUSD", datetime.date(2026, 1, 1) + datetime.timedelta(days=i), k, i) for i, k in enumerate(kinds)], "pair string, date date, kind string, i int")


def test_holes(spark):
    days = series(spark, ["data", "empty", "unprobed", "missing", "data", "empty", "data", "missing", "missing"])
    got = sorted((r.first_i, r.last_i, r.trading_days, dict(r.composition)) for r in V.holes(days, 2).collect())
    assert got == [(1, 3, 3, {"empty": 1, "missing": 1, "unprobed": 1}), (7, 8, 2, {"missing": 2})]


def test_recommended_start(spark):
    stray = series(spark, ["data"] + ["empty"] * 6 + ["data"] * 10)
    r = V.recommended_start(stray, 0.9, 3).first()
    assert (r.start.day, r.first_data.day, r.days_from_start) == (8, 1, 10)
    none = V.recommended_start(series(spark, ["unprobed"] * 3), 0.9, 3).first()
    assert (none.start, none.days_from_start) == (None, 0)


def test_logs(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text(json.dumps({"record": "start", "experiment_id": "E", "taskcard": "T", "started_at": "2026-01-02"}) + "\n" + json.dumps({"record": "end", "experiment_id": "E", "ended_at": "2026-01-01", "status": 'ok {"completed": 3, "seconds": 1.5}'}) + '\n{"record": "st')
    ledger = logs.read_ledger(spark, str(path))
    assert sorted(r.record for r in ledger.collect()) == ["end", "malformed", "start"]
    assert logs.ordering_violations(ledger).count() == 1
    assert logs.harvest_costs(ledger).first().probes == 3
    probes = tmp_path / "probes.jsonl"
    probes.write_text('{"pair":"EURUSD","date":"2026-01-01","hour":13,"kind":"data"}\n{"pair":"EU')
    assert logs.read_probes(spark, str(probes)).count() == 1


def test_streams(spark, tmp_path):
    rows = [("EURUSD", datetime.datetime(2026, 7, 14, h, m, tzinfo=UTC), 1.1, 1.2, 1.0, 1.0, "s", h * 60 + m) for h in range(8) for m in range(0, 60, 7)]
    rows.append(("EURUSD", datetime.datetime(2026, 7, 14, 9, tzinfo=UTC), 0.0, 1.2, 1.0, 1.0, "s", 999))
    df = spark.createDataFrame(rows, TICKS.plus("seq long"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream_bars(source, "1h").writeStream.format("memory").queryName("made").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("made").count() >= 7
    recorder(source, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows) - 1


def test_sorted_recorder(spark, tmp_path):
    rows = [("EURUSD", datetime.datetime(2026, 7, 14, 5, m, tzinfo=UTC), 1.1, 1.2, 1.0, 1.0, "s") for m in (9, 3, 7, 1)]
    spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
    sorted_recorder(source, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("ts", "_metadata.row_index").orderBy("row_index").collect()
    assert [r.ts.minute for r in got] == [1, 3, 7, 9]


def test_candle_source():
    source = feeds.CandleSource(lambda url: (200, url.encode()), "base")
    assert source.candles("EURUSD", "a", "b").startswith(b"base/v3/instruments/EUR_USD/candles?price=BAM")
    for bad in ("/v3/accounts/1/orders", "/v3/pricing/stream/candles"):
        with pytest.raises(PermissionError):
            source.check(bad)
    with pytest.raises(feeds.SourceError):
        feeds.CandleSource(lambda url: (500, b""), "b").candles("EURUSD", "a", "b")


def test_candles_and_manifest_documents(spark, tmp_path):
    q = {"o": "1.1", "h": "1.2", "l": "1.0", "c": "1.15"}
    doc = {"instrument": "EUR_USD", "granularity": "H1", "candles": [{"time": "2026-07-14T13:00:00.123456789Z", "complete": True, "volume": 5, "bid": q, "ask": q, "mid": q}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    r = logs.read_candles(spark, str(tmp_path / "c.json")).first()
    assert (r.pair, r.mid_close, r.ts.microsecond) == ("EURUSD", 1.15, 123456)
    (tmp_path / "m.json").write_text(json.dumps({"hours": [{"pair": "EURUSD", "date": "2026-07-14", "hour": 3, "status": "ok", "issues": [{"reason": "X", "detail": "d", "count": 2}]}]}))
    m = logs.read_manifest(spark, str(tmp_path / "m.json"), MANIFEST_HOURS).first()
    assert (m.hour, m.status, m.issues[0]["count"]) == (3, "ok", 2)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1234567, 0.5), ("b|c", None, 2.0)], "k string, n long, x double").orderBy("k")
    assert R.markdown(df).splitlines()[2] == "| a | 1,234,567 | 0.5 |"
    assert R.markdown(df, 1).endswith("1 more rows are not shown.")
    assert df.agg(R.result_hash(df)).first()[0] == df.orderBy(F.desc("k")).agg(R.result_hash(df)).first()[0]
    hours = spark.createDataFrame([("EURUSD", datetime.date(2026, 7, 14), 3, "ok")], "pair string, date date, hour int, status string")
    store.write_manifest(hours, str(tmp_path / "m"))
    store.write_manifest(hours.withColumn("status", F.lit("gap")), str(tmp_path / "m"))
    assert [r.status for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["gap"]


def test_sources(tmp_path):
    day = datetime.date(2026, 7, 14)
    (tmp_path / "EURUSD_2026-07-14_12h.bi5").write_bytes(b"abc")
    (tmp_path / "EURUSD_2026-07-14_13h.bi5").write_bytes(b"")
    source = feeds.build_source("folder", root=str(tmp_path))
    assert [source.fetch("EURUSD", day, h).availability for h in (12, 13, 14)] == ["present", "empty", "missing"]
    answers, waits = iter([(503, b""), (429, b""), (200, b"x")]), []
    http = feeds.HttpSource(lambda url: next(answers), "base", sleep=waits.append)
    assert http.fetch("EURUSD", day, 3).content == b"x"
    assert waits == [1.0, 2.0]
    assert http.url("EURUSD", day, 3) == "base/EURUSD/2026/06/14/03h_ticks.bi5"
    assert feeds.HttpSource(lambda url: (404, b""), "b").fetch("EURUSD", day, 3).availability == "missing"
    with pytest.raises(feeds.SourceError):
        feeds.HttpSource(lambda url: (403, b""), "b").fetch("EURUSD", day, 3)
    with pytest.raises(feeds.OfflineError):
        feeds.build_source("blocked").fetch("EURUSD", day, 3)
    out = tmp_path / "landed"
    out.mkdir()
    assert [x[3] for x in feeds.land(source, iter([("EURUSD", day, 12), ("EURUSD", day, 14)]), str(out))] == ["present", "missing"]
    assert [p.name for p in out.iterdir()] == ["EURUSD_2026-07-14_12h.bi5"]


def test_settings():
    s = config.ingest_settings('[ingest]\nroot = "x"\ntimeframes = ["5m"]\n[[ingest.hours]]\npair = "eur_usd"\ndate = "2026-07-14"\nhour = 3\n[[ingest.range]]\npairs = ["EURUSD"]\nfirst = "2026-07-14"\nlast = "2026-07-15"\nhours = [3, 4]\n')
    assert len(s.requests) == 4
    assert s.timeframes == ("5min",)
    for bad in ("[backtest]\nfast = 9\nslow = 3", "[backtest]\nspeed = 3", "[backtest.costs]\nfoo = 1"):
        with pytest.raises(config.ConfigError):
            config.backtest_settings(bad)
    assert config.backtest_settings("[backtest]\npairs = ['EUR/USD']").pairs == ("EURUSD",)


def entry(params, seed, loader):
    return {"answer": params["x"] * 2.00000000001, "seed": seed}


def test_experiments_repeat(spark, tmp_path):
    e = research.Experiment("E-1", "T9", f"{__name__}:entry", 7, params={"x": 3})
    hashes = [research.run_experiment(e, research.Loader(spark, (str(tmp_path),)), str(tmp_path / "ledger.jsonl"), str(tmp_path / f"{k}.json")) for k in "ab"]
    assert hashes[0] == hashes[1]
    ledger = logs.read_ledger(spark, str(tmp_path / "ledger.jsonl"))
    assert ledger.count() == 4
    assert logs.ordering_violations(ledger).count() == 0
    assert Path(tmp_path / "a.json").read_bytes() == Path(tmp_path / "b.json").read_bytes()


def test_seal_refuses_without_data(spark, tmp_path):
    loader = research.Loader(spark, (str(tmp_path),))
    with pytest.raises(research.SealedError):
        loader.ticks(str(tmp_path), ["EURUSD"], "2025-02-27", "2025-03-01")
    assert loader.ticks(str(tmp_path), ["EURUSD"], "2025-02-01", "2025-02-28").count() == 0
    with pytest.raises(PermissionError):
        loader.ticks("/etc", ["EURUSD"], "2024-01-01", "2024-01-02")


def test_schema_check(spark):
    with pytest.raises(SchemaError, match="bid: string"):
        require(spark.createDataFrame([("EURUSD", "x")], "pair string, bid string"), TICKS)


def test_parts_of_a_day_stay(spark, tmp_path):
    """Writing one part of a day leaves the hours of the other."""
    def hours(some, up=0.0):
        return spark.createDataFrame([("EURUSD", datetime.datetime(2026, 7, 14, h, 5, tzinfo=UTC), 1.1 + up, 1.1002 + up, 1.0, 1.0, "t") for h in some], TICKS)

    root = str(tmp_path)
    store.write_ticks(hours(range(12)), root)
    store.write_ticks(hours(range(12, 24)), root)
    store.write_ticks(hours([5], 0.5), root)
    got = {r.ts.hour: r.bid for r in store.read_ticks(spark, root).collect()}
    assert got == {h: pytest.approx(1.6 if h == 5 else 1.1) for h in range(24)}
    assert {r.hour for r in store.listing(store.files(spark, f"{root}/ticks")).collect()} == set(range(24))
    old = store.files(spark, f"{root}/ticks").limit(0).unionByName(spark.createDataFrame([("x/pair=EURUSD/date=2026-07-14/EURUSD_2026-07-14_03h_ab.parquet", 1)], "path string, length long"))
    assert [r.hour for r in store.listing(old).collect()] == [3]  # stores whose file names carry the hour


def test_ingest_goes_on_where_it_stopped(spark, folder, tmp_path):
    from tickloom.plans.ingest import ingest_in_steps, still_pending

    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    asked = requests.request_grid(spark, ["EURUSD"], "2026-07-11", "2026-07-14", (12, 13, 15, 16, 19)).unionByName(requests.request_grid(spark, ["USDJPY"], "2026-07-14", "2026-07-14", (12,)))
    morning = asked.where("hour < 15")
    steps = [r.count() for r in ingest_in_steps(spark, str(folder), morning, out, manifest, days_per_step=1)]
    assert len(steps) == 4
    first = {(r.pair, r.ts) for r in store.read_ticks(spark, out).collect()}
    left = {(r.pair, r.date.day, r.hour) for r in still_pending(spark, asked, out, manifest).collect()}
    assert ("EURUSD", 14, 12) not in left
    assert {("EURUSD", 14, 13), ("EURUSD", 14, 15), ("EURUSD", 14, 16), ("EURUSD", 14, 19)} <= left
    for _ in ingest_in_steps(spark, str(folder), asked, out, manifest):
        pass
    assert first < {(r.pair, r.ts) for r in store.read_ticks(spark, out).collect()}
    rows = {(r.pair, r.date.day, r.hour): r.status for r in store.read_stored_manifest(spark, manifest).collect()}
    assert len(rows) == asked.count()
    assert (rows["EURUSD", 14, 12], rows["EURUSD", 14, 15], rows["EURUSD", 14, 16], rows["EURUSD", 14, 13]) == ("ok", "ok", "empty", "gap")
    import shutil

    shutil.rmtree(f"{out}/ticks/pair=USDJPY/date=2026-07-14/hour=12")
    assert ("USDJPY", 14, 12) in {(r.pair, r.date.day, r.hour) for r in still_pending(spark, asked, out, manifest).collect()}


def test_transport_faults_are_retried():
    day, waits = datetime.date(2026, 7, 14), []
    answers = iter([TimeoutError("slow"), ConnectionError("reset"), (503, b""), (200, b"x")])

    def get(url):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert feeds.HttpSource(get, "b", pause=40.0, sleep=waits.append).fetch("EURUSD", day, 3).content == b"x"
    assert waits == [40.0, 60.0, 60.0]  # the pause has a ceiling

    def never(url):
        raise TimeoutError("slow")

    with pytest.raises(feeds.SourceError, match="TimeoutError"):
        feeds.HttpSource(never, "b", sleep=waits.append).fetch("EURUSD", day, 3)
    assert [x[3][:11] for x in feeds.land(feeds.HttpSource(never, "b", sleep=waits.append), iter([("EURUSD", day, 3)]), ".")] == ["FETCH_ERROR"]
    with pytest.raises(PermissionError):
        feeds.CandleSource(lambda url: (200, b""), "b").check("/v3/accounts/1/ORDERS/candles")


def test_seal_on_bars(spark, tmp_path):
    def bars_of(*days):
        rows = [("EURUSD", datetime.datetime.fromisoformat(f"{d}T12:00:00+00:00"), *[1.0] * 12, 1, 0.1, 0.1) for d in days]
        return spark.createDataFrame(rows, "pair string, ts timestamp, " + ", ".join(f"{q}_{x} double" for q in ("bid", "ask", "mid") for x in ("open", "high", "low", "close")) + ", tick_count bigint, spread_mean double, spread_max double").withColumn("timeframe", F.lit("1h"))

    def days_of(frame):
        return frame.select("timeframe", "pair", F.to_date("ts").alias("date"))

    root = str(tmp_path)
    before = bars_of("2025-02-26", "2025-02-27")
    store.write_bars(before, days_of(before), root)
    loader = research.Loader(spark, (root,))
    assert loader.bars(root, "1h", ["EURUSD"], "2025-02-01", "2025-02-28").count() == 2
    assert loader.bars(root, "1h", ["EURUSD"], "2024-01-01", "2024-01-02").count() == 0  # no bars in range: no crash
    with pytest.raises(research.SealedError):
        loader.bars(root, "1h", ["EURUSD"], "2025-02-01", "2025-03-01")  # though there are none that late
    after = bars_of("2025-03-03")
    store.write_bars(after, days_of(after), root)
    with pytest.raises(research.SealedError):
        loader.bars(root, "1h", ["EURUSD"])
    assert loader.bars(root, "1h", ["EURUSD"], "2025-02-01", "2025-02-28").count() == 2
    assert research.Loader(spark, (root,), "mechanical").bars(root, "1h", ["EURUSD"]).count() == 3
    with pytest.raises(PermissionError, match="whatever"):
        research.Loader(spark, (root,), "whatever")


def test_recorded_files_hold_one_hour(spark, tmp_path):
    from tickloom.streaming.live import recorder, sorted_recorder

    rows = [("EURUSD", datetime.datetime(2026, 7, 14, h, m, tzinfo=UTC), 1.1, 1.2, 1.0, 1.0, "live") for h in (9, 10) for m in range(0, 60, 7)]
    spark.createDataFrame(rows, TICKS).write.parquet(str(tmp_path / "in"))
    for name, make in (("a", recorder), ("b", sorted_recorder)):
        source = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
        make(source, str(tmp_path / name), str(tmp_path / f"state-{name}")).trigger(availableNow=True).start().awaitTermination()
        made = spark.read.option("recursiveFileLookup", "true").schema(TICKS).parquet(str(tmp_path / name))
        by_file = made.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.countDistinct(F.hour("ts")).alias("n")).collect()
        assert made.count() == len(rows)
        assert {r.n for r in by_file} == {1}


def test_ties_across_large_sequence_numbers(spark):
    """Of ticks in one microsecond the smaller number opens and the larger closes, whatever the numbers and their type."""
    at = datetime.datetime(2026, 7, 14, 12, 0, 1, tzinfo=UTC)
    for low, kind in ((2**26 - 1, "int"), (2**26 - 1, "long"), (2**37 - 1, "long"), (2**53 - 1, "long"), (2**62, "long")):
        frame = spark.createDataFrame([("EURUSD", at, low + 1, 1.2, 1.3), ("EURUSD", at, low, 1.0, 1.1)], f"pair string, ts timestamp, seq {kind}, bid double, ask double")
        for name in ("1min", "1h", "4h", "1D"):
            r = B.bars(frame, name).first()
            assert (r.bid_open, r.bid_close) == (1.0, 1.2), (low, kind, name)
