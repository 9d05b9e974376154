"""Commands, report documents, the control of requests, and the spool of live quotes."""

from __future__ import annotations

import datetime
import json

import numpy as np
import pytest
from test_store import hour

from tickloom.__main__ import main
from tickloom.functions import calendar as cal
from tickloom.sources import bi5, control, feeds, quotes, requests, store
from tickloom.streaming.live import recorder

TUESDAY = datetime.date(2026, 7, 14)


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


class Script:
    """Answers in turn: an exception is raised, bytes are an hour."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), 0

    def fetch(self, pair, day, hour):
        self.asked += 1
        answer = self.answers.pop(0) if self.answers else b"x"
        if isinstance(answer, Exception):
            raise answer
        return feeds.RawHour(answer, "script", "present" if answer else "empty")


def paced(source, **kw):
    clock = Clock()
    return control.PacedSource(source, clock=clock, sleep=clock.sleep, **kw), clock


def test_requests_keep_their_gap_and_closed_hours_stay_here():
    source, clock = paced(Script())
    for _ in range(3):
        source.fetch("EURUSD", TUESDAY, 12)
    assert clock.now == pytest.approx(2 * control.BASE_GAP / control.LOWEST)
    assert source.fetch("EURUSD", datetime.date(2026, 7, 11), 12).availability == "empty"
    assert source.source.asked == 3 and source.counts["closed"] == 1


def test_one_throttle_is_no_outage_and_two_are():
    busy = feeds.Throttled("busy")
    source, clock = paced(Script(busy))
    assert source.fetch("EURUSD", TUESDAY, 12).content == b"x"
    assert clock.now < 1 and source.counts["outages"] == 0 and source.counts["throttles"] == 1
    source, clock = paced(Script(busy, busy, busy))
    assert source.fetch("EURUSD", TUESDAY, 12).content == b"x"
    assert clock.now >= control.PARKS[0] + control.PARKS[1] and source.counts["outages"] == 1
    assert source.counts["parked"] == control.PARKS[0] + control.PARKS[1]


def test_an_outage_and_the_attempts_end():
    source, clock = paced(Script(*[feeds.Throttled("busy")] * 50), attempts=40, outage=100.0)
    with pytest.raises(feeds.Throttled):
        source.fetch("EURUSD", TUESDAY, 12)
    assert clock.now < 400
    source, _ = paced(Script(*[feeds.Throttled("busy")] * 50), attempts=3)
    with pytest.raises(feeds.Throttled):
        source.fetch("EURUSD", TUESDAY, 12)
    assert source.source.asked == 3
    source, _ = paced(Script(feeds.SourceError("forbidden")))
    with pytest.raises(feeds.SourceError):
        source.fetch("EURUSD", TUESDAY, 12)
    assert source.source.asked == 1


def test_http_source_tells_busy_from_refused():
    def answers(status):
        return feeds.HttpSource(lambda url: (status, b""), "b", attempts=2, sleep=lambda s: None)

    with pytest.raises(feeds.Throttled):
        answers(503).fetch("EURUSD", TUESDAY, 12)
    with pytest.raises(feeds.SourceError) as e:
        answers(403).fetch("EURUSD", TUESDAY, 12)
    assert not isinstance(e.value, feeds.Throttled)


def test_levels():
    def after(shares, state=None):
        state, seen = state or control.Level(), []
        for n, share in enumerate(shares, 1):
            state, decision = control.judge(state, n * control.WINDOW_SECONDS, share)
            seen.append(decision)
        return state, seen

    state, seen = after([0.01] * 12)
    assert state.level == 4 and [i for i, d in enumerate(seen, 1) if d == "up"] == [6, 12]
    state, seen = after([0.01] * 6 + [0.2, 0.01, 0.2, 0.2])
    assert seen[6:] == ["bad", "stay", "bad", "down"] and state.level == 2 and dict(state.shut)[3] == 6000 + control.RETRY_LEVEL_SECONDS
    state, seen = after([0.5, 0.5] + [0.0] * 40)
    assert dict(state.shut)[3] == 1200 + control.RETRY_LEVEL_SECONDS
    assert seen.index("up") + 1 == (1200 + control.RETRY_LEVEL_SECONDS) / control.WINDOW_SECONDS
    state, seen = after([0.0] * 6 + [0.03, 0.03])
    assert seen[-1] == "down", "worse than the level below by over the margin, although under the cap"
    assert after([0.09] * 6 + [0.101, 0.101])[1][-1] == "down", "the cap holds whatever the level below had"


def test_fetch_all_steps_up_and_keeps_order():
    source, clock = paced(Script())
    control_ = control.Controller(clock=clock)
    hours = [("EURUSD", TUESDAY, h % 24) for h in range(400)]
    got = []
    for pair, day, h, raw in control.fetch_all(source, (r for _ in range(60) for r in hours), control_, chunk=200):
        got.append(h)
        assert isinstance(raw, feeds.RawHour)
    assert len(got) == 24_000 and got[:5] == [0, 1, 2, 3, 4]
    assert control_.state.level > control.LOWEST and source.gap < control.BASE_GAP / control.LOWEST
    assert control_.record()["final_level"] == control_.state.level


def test_probe_records():
    answers = [("EURUSD", TUESDAY, 1, feeds.RawHour(b"abc", "", "present")), ("EURUSD", TUESDAY, 2, feeds.RawHour(b"", "", "missing")), ("EURUSD", TUESDAY, 3, feeds.Throttled("busy"))]
    kinds = [(r["kind"], r["ticks"]) for r in control.probe_records(answers, "main", len)]
    assert kinds == [("data", 3), ("missing", 0), ("error", 0)]


def test_addresses():
    clock = Clock()
    pool = control.Addresses(["a", "b", "c"], clock)
    assert [pool.pick() for _ in range(4)] == ["a", "b", "c", "a"]
    pool.failed("b")
    assert "b" not in {pool.pick() for _ in range(6)}
    clock.now += 3
    assert "b" in {pool.pick() for _ in range(3)}
    for name in "abc":
        pool.failed(name)
    pool.failed("a")
    assert pool.pick() in "bc"


def test_open_hours_agree_with_the_columns(spark):
    rows = requests.open_hours(spark, "2026-03-01", "2026-04-05").collect()
    assert all(control.open_hour(r.date, r.hour) == r.open and control.near_open(r.date, r.hour) == r.reaches_feed for r in rows)
    assert cal.WEEK_HOUR == 17


def test_spool(spark, tmp_path):
    folder = str(tmp_path / "spool")
    sent = [("EURUSD", 1_000_000 * k, 1.1, 1.2 if k % 3 else None, 1.0, None) for k in range(100)] + [("XXXYYY", 5, 1.0, 1.0, 1.0, 1.0)]
    assert quotes.subscribe(iter(sent), folder, ["EURUSD"], flush_every=7) == {"EURUSD": 100}
    with open(f"{folder}/EURUSD.quotes", "ab") as f:
        f.write(b"cut off")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        recorder(quotes.live_quotes(spark, folder, ["EURUSD", "USDJPY"]), out, state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 66
    assert quotes.subscribe(iter([("EURUSD", 200_000_000, 1.1, 1.2, 1.0, 1.0)]), folder, ["EURUSD"]) == {"EURUSD": 101}
    assert run() == 67
    assert run() == 67
    with pytest.raises(ValueError, match="pairs"):
        quotes.SpoolReader({"path": folder})


@pytest.fixture
def stored(spark, tmp_path):
    """A store that the command filled from 60 hours' files."""
    root = tmp_path / "files"
    root.mkdir()
    for n, h in enumerate(range(20)):
        for d in (14, 15, 16):
            (root / f"EURUSD_2026-07-{d}_{h:02d}h.bi5").write_bytes(bi5.encode_hour(hour(seed=100 * d + n, base=110_000 + 10 * ((n * 7 + d) % 5))))
    out = tmp_path / "out"
    settings = tmp_path / "ingest.toml"
    settings.write_text(f'[ingest]\nsource = "folder"\nroot = "{root}"\nout = "{out}"\ntimeframes = ["1h", "1D"]\n[[ingest.range]]\npairs = ["EURUSD"]\nfirst = 2026-07-14\nlast = 2026-07-16\nhours = {list(range(20))}\n')
    assert main(["ingest", "--config", str(settings)]) == 0
    return tmp_path, str(out), settings


def test_commands(spark, stored, capsys):
    tmp_path, out, settings = stored
    assert main(["bars", "--store", out, "--timeframes", "4h"]) == 0
    assert main(["bars", "--store", str(tmp_path / "none")]) == 3
    assert store.read_bars(spark, out, "1h").count() == 60

    cfg = tmp_path / "backtest.toml"
    cfg.write_text('[backtest]\npairs = ["EURUSD"]\ntimeframe = "1h"\nfast = 2\nslow = 5\n')
    capsys.readouterr()
    assert main(["backtest", "--config", str(cfg), "--store", out, "--out", str(tmp_path / "result")]) == 0
    total = json.loads(capsys.readouterr().out)
    assert total["bar_count"] == 60 and total["trade_count"] > 0
    assert spark.read.text(str(tmp_path / "result")).where("part = 'trade'").count() == total["trade_count"]
    cfg.write_text('[backtest]\npairs = ["USDJPY"]\n')
    assert main(["backtest", "--config", str(cfg), "--store", out]) == 3
    cfg.write_text('[backtest]\nfast = 9\nslow = 5\n')
    assert main(["backtest", "--config", str(cfg), "--store", out]) == 2

    assert main(["report", "--store", out, "--out", str(tmp_path / "report.md")]) == 0
    text = (tmp_path / "report.md").read_text()
    assert [line[3:] for line in text.splitlines() if line.startswith("## ")] == ["Totals", "Pairs", "Years", "Gaps", "Boundaries", "Validation", "Storage", "Bars"]
    assert "| ok | 60 | 5,400 |" in text
    assert main(["report", "--store", str(tmp_path / "none")]) == 3


def test_crosscheck_command(spark, stored, capsys):
    tmp_path, out, _ = stored
    rows = store.read_bars(spark, out, "1h").collect()

    def candles(shift):
        def quote(r, q):
            return {short: f"{r[f'{q}_{long}'] + shift:.6f}" for short, long in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))}

        made = [{"time": r.ts.strftime("%Y-%m-%dT%H:%M:%S.000000000Z"), "complete": True, "volume": r.tick_count} | {q: quote(r, q) for q in ("bid", "ask", "mid")} for r in rows]
        path = tmp_path / f"candles{shift}.json"
        path.write_text(json.dumps({"instrument": "EUR_USD", "granularity": "H1", "candles": made}))
        return str(path)

    assert main(["crosscheck", "--store", out, "--candles", candles(0.0)]) == 0
    capsys.readouterr()
    assert main(["crosscheck", "--store", out, "--candles", candles(0.0005)]) == 1
    assert "| EURUSD | 60 |" in capsys.readouterr().out
    assert main(["crosscheck", "--store", out, "--candles", str(tmp_path / "none")]) == 3


def test_survey_command(spark, tmp_path):
    rng = np.random.default_rng(0)
    days = [r["date"] for r in requests.trading_days(spark, "2024-01-01", "2024-06-30", 13).orderBy("date").collect()]
    lines = [{"pair": "EURUSD", "date": d.isoformat(), "hour": 13, "kind": "error", "status": 503, "compressed_bytes": 0, "ticks": 0, "attempts": 1, "stage": "main", "detail": ""} for d in days]
    lines += [line | {"kind": "empty" if 40 <= k < 52 else "data", "ticks": int(rng.integers(1, 99))} for k, line in enumerate(lines)]
    path = tmp_path / "probes.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    assert main(["survey", "--probes", str(path), "--pairs", "EURUSD,USDJPY", "--first", "2024-01-01", "--last", "2024-06-30", "--out", str(tmp_path / "c.md")]) == 0
    text = (tmp_path / "c.md").read_text()
    assert [line[3:] for line in text.splitlines() if line.startswith("## ")] == ["Completeness", "Starts", "Years", "Holes", "Extremes"]
    assert f"| EURUSD | {len(days) - 12} | 12 | 0 | 0 | 0 |" in text, "the later line of each hour counts"
    assert main(["survey", "--probes", str(tmp_path / "none"), "--pairs", "EURUSD", "--first", "2024-01-01", "--last", "2024-01-02"]) == 3


def entry(params, seed, loader):
    return {"answer": params["x"] * seed}


def test_experiment_command(spark, tmp_path, capsys):
    cfg = tmp_path / "e.toml"
    cfg.write_text(f'experiment_id = "E-9"\ntaskcard = "T1"\nentry = "{__name__}:entry"\nseed = 4\nledger = "{tmp_path}/ledger.jsonl"\nroots = ["{tmp_path}"]\n[params]\nx = 2\n')
    assert main(["experiment", "--config", str(cfg)]) == 0
    first = capsys.readouterr().out
    assert main(["experiment", "--config", str(cfg), "--reproduce"]) == 0
    assert capsys.readouterr().out == first
    assert len((tmp_path / "ledger.jsonl").read_text().splitlines()) == 2
    cfg.write_text('experiment_id = "E-9"\n')
    assert main(["experiment", "--config", str(cfg)]) == 2
