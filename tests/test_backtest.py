"""Known answers of the cost model, the back-test and the splits, and the wrong answers that give bugs away."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest as T
from tickloom.operators import costs as C
from tickloom.operators import walkforward as W

# Opening and closing mids of ten hourly bars; bid and ask lie 0.0001 to either side.
OPENS = [1.1, 1.1, 1.1, 1.1, 1.1, 1.112, 1.12, 1.13, 1.12, 1.098]
CLOSES = [1.1, 1.1, 1.1, 1.1, 1.11, 1.12, 1.13, 1.12, 1.1, 1.09]
START = datetime.datetime(2026, 7, 14, tzinfo=datetime.UTC)


def bars(spark, pairs=("EURUSD",)):
    rows = [(p, START + datetime.timedelta(hours=i), o - 0.0001, o + 0.0001, c - 0.0001, c + 0.0001, c) for p in pairs for i, (o, c) in enumerate(zip(OPENS, CLOSES, strict=True))]
    return spark.createDataFrame(rows, "pair string, ts timestamp, bid_open double, ask_open double, bid_close double, ask_close double, mid_close double")


@pytest.mark.parametrize(("units", "gross", "spread", "commission", "net"), [(1_000_000, -14_000, 200, 44.2, -14_244.2), (5_000, -70, 1, 4, -75)])
def test_known_answer(spark, units, gross, spread, commission, net):
    aimed = T.moving_average_target(bars(spark), 2, 4, units)
    done = T.trades(T.executions(aimed, C.CostModel())).collect()
    assert len(done) == 1
    t = done[0]
    assert (t.entry_ts.hour, t.exit_ts.hour, t.forced) == (5, 9, False)
    for got, want in ((t.gross, gross), (t.spread_cost, spread), (t.commission, commission), (t.net, net)):
        assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("model", "wrong"), [(C.CostModel(rate=0, floor=0), -14_200), (C.CostModel(rate=0, floor=0, spread_by_session=(), default_spread=0.0), -14_000), (C.CostModel(spread_by_session=(), default_spread=0.0), -14_044.2)])
def test_wrong_costs_are_told_apart(spark, model, wrong):
    aimed = T.moving_average_target(bars(spark), 2, 4, 1_000_000)
    net = T.trades(T.executions(aimed, model)).agg(F.sum("net")).first()[0]
    assert net == pytest.approx(wrong, abs=0.05)
    assert abs(net + 14_244.2) > 1


def test_acting_on_the_same_bar_would_show(spark):
    """Targets known one bar too early give the answer that betrays look-ahead."""
    from pyspark.sql import Window

    aimed = T.moving_average_target(bars(spark), 2, 4, 1_000_000)
    early = aimed.withColumn("target", F.lead("target", 1, 0.0).over(Window.partitionBy("pair").orderBy("ts")))
    net = T.trades(T.executions(early, C.CostModel())).agg(F.sum("net")).first()[0]
    assert abs(net + 14_244.2) > 1


def test_equal_means_are_flat(spark):
    rows = [("EURUSD", START + datetime.timedelta(hours=i), 0.1) for i in range(12)]
    flat = T.moving_average_target(spark.createDataFrame(rows, "pair string, ts timestamp, mid_close double"), 3, 5, 1.0)
    assert flat.agg(F.max("target")).first()[0] == 0


def test_fold_and_equity_against_an_event_loop(spark):
    """Random targets of either sign, on pairs with bars at different instants."""
    rng = random.Random(5)
    rows, targets = [], {}
    for p in ("AAAUSD", "BBBUSD", "CCCUSD"):
        for i in range(40):
            if rng.random() < 0.7:
                o, c = round(1 + rng.random() / 10, 5), round(1 + rng.random() / 10, 5)
                targets[p, i] = rng.choice([0, 0, 1000, 2000, 3000, -1000, -2500])
                rows.append((p, START + datetime.timedelta(hours=i), o - 1e-4, o + 1e-4, c - 1e-4, c + 1e-4, c, float(targets[p, i])))
    df = spark.createDataFrame(rows, "pair string, ts timestamp, bid_open double, ask_open double, bid_close double, ask_close double, mid_close double, target double")
    model = C.CostModel(floor=0.01)
    executed = T.executions(df, model)
    got = sorted((r.pair, r.units, round(r.gross, 6), round(r.spread_cost + r.commission, 6), r.forced) for r in T.trades(executed).collect())
    want, curve, cash = [], {}, 0.0
    state: dict[str, list] = {}
    last, pending, mids = {r[0]: r[1] for r in sorted(rows, key=lambda r: r[1])}, {}, {}

    def order(p, units, bid, ask, forced=False):
        nonlocal cash
        mid, fill = (bid + ask) / 2, ask if units > 0 else bid
        cost = abs(fill - mid) * abs(units) + max(2e-05 * (abs(units) * fill), 0.01)
        cash -= units * mid + cost
        s = state.setdefault(p, [0.0, 0.0, 0.0])  # units, entry mid, entry cost
        if s[0] == 0 or (s[0] > 0) == (units > 0):
            s[1] = (s[1] * abs(s[0]) + mid * abs(units)) / (abs(s[0]) + abs(units))
            s[0], s[2] = s[0] + units, s[2] + cost
            return
        closing, way = min(abs(s[0]), abs(units)), 1 if s[0] > 0 else -1
        share = closing / abs(s[0])
        want.append((p, closing * way, round((mid - s[1]) * closing * way, 6), round(s[2] * share + cost, 6), forced))
        s[0], s[2] = s[0] + units, s[2] * (1 - share)

    for ts in sorted({r[1] for r in rows}):
        here = sorted(r for r in rows if r[1] == ts)
        for p, _, bo, ao, _, _, _, _ in here:
            now, aim = state.get(p, [0.0])[0], pending.get(p, 0.0)
            if now * aim < 0:
                order(p, -now, bo, ao)
                now = 0.0
            if aim != now:
                order(p, aim - now, bo, ao)
        for p, _, _, _, bc, ac, c, aim in here:
            pending[p], mids[p] = aim, c
            if last[p] == ts and state.get(p, [0.0])[0]:
                order(p, -state[p][0], bc, ac, True)
        curve[ts] = cash + sum(s[0] * mids[p] for p, s in state.items())
    assert got == sorted(want)
    found = {r.ts.replace(tzinfo=datetime.UTC): r.equity for r in T.equity(df, executed).collect()}
    assert set(found) == set(curve)
    assert all(found[k] == pytest.approx(v, abs=1e-6) for k, v in curve.items())


# A price path with the answers of an honest split and of two that leak.
PRICES = [100, 101, 100, 101, 100, 101, 100, 101, 100, 100, 111, 122, 123, 126, 125, 126, 125, 136, 147, 158]


def test_leakage_answers(spark):
    rows = [("x", i, float(p)) for i, p in enumerate(PRICES)]
    b = W.returns(spark.createDataFrame(rows, "pair string, ts int, p double"), "p")
    split = W.windows(spark, 20, 9, 5, 2, 2, start=1)
    r = W.run(split, b, "previous", "forward", 2).first()
    assert (r.pnl, r.signal_sum, r.n_train, r.n_test) == (-11, 1, 9, 5)
    state = W.fit_zscore(W.training(split, b, 2), "previous")
    peek = W.testing(split, b).join(state, "w").withColumn("s", W.zscore_sign(F.col("forward"), F.col("mean"))).agg(F.sum(F.col("s") * F.col("forward")), F.sum("s")).first()
    assert tuple(peek) == (17, 1)
    unpurged = W.windows(spark, 20, 11, 5, 0, 0, start=1)
    assert W.run(unpurged, b, "previous", "forward", 0).first().pnl != -11


def test_geometry(spark):
    split = W.windows(spark, 35, 10, 5, 2, 3, expanding=True)
    b = spark.range(35).select(F.col("id").alias("i"))
    got = {r.w: sorted(x.i for x in W.training(split, b, 3).where(F.col("w") == r.w).collect()) for r in split.collect()}
    assert got == {0: list(range(10)), 1: list(range(15)), 2: list(range(17)), 3: [*range(17), 20, 21]}


def brute(n, train, test, purge, embargo, start, expanding):
    out, barred, lo = [], set(), start + train + purge
    while lo + test <= n:
        idx = [i for i in range(start if expanding else max(start, lo - purge - train), lo - purge) if i not in barred]
        if not idx:
            return None
        out.append(idx)
        barred |= set(range(lo + test, min(lo + test + embargo, n)))
        lo += test
    return out


@pytest.mark.parametrize("seed", range(12))
def test_windows_against_brute_force(spark, seed):
    rng = random.Random(seed)
    args = rng.randint(15, 50), rng.randint(1, 9), rng.randint(1, 6), rng.randint(0, 3), rng.randint(0, 8), rng.randint(0, 3), rng.random() < 0.5
    want = brute(*args)
    if want is None:
        with pytest.raises(W.WalkForwardError):
            W.windows(spark, *args)
        return
    split = W.windows(spark, *args)
    rows = W.training(split, spark.range(args[0]).select(F.col("id").alias("i")), args[4]).select("w", "i").collect()
    got: dict[int, list[int]] = {}
    for r in rows:
        got.setdefault(r.w, []).append(r.i)
    assert [sorted(got[w]) for w in range(len(want))] == want


def test_dollar_costs(spark):
    """Floors and spreads in dollars at the mid of the fill's time."""
    at = START
    mids = spark.createDataFrame([("USDJPY", at, 150.0), ("USDCHF", at, 0.9)], "pair string, ts timestamp, mid double")
    fills = [("USDJPY", at, 150.0, 150.0, 50_000.0), ("USDJPY", at, 150.0, 150.0, 1_000_000.0), ("USDJPY", at, 150.015, 150.0, 100_000.0), ("EURCHF", at, 0.95, 0.95, 1000.0), ("EURUSD", at, 1.1, 1.1, 1000.0)]
    got = C.dollar_costs(spark.createDataFrame(fills, "pair string, ts timestamp, fill double, quote_mid double, units double"), mids).collect()
    by = {(r.pair, r.units): r for r in got}
    assert by["USDJPY", 50_000].commission_usd == pytest.approx(2.0)
    assert by["USDJPY", 1_000_000].commission_usd == pytest.approx(20.0)
    assert by["USDJPY", 100_000].spread_usd == pytest.approx(10.0)
    assert by["EURCHF", 1000].to_usd == pytest.approx(1 / 0.9)
    assert 300 * by["EURUSD", 1000].to_usd + 3000 * by["USDJPY", 50_000].to_usd - 180 * by["EURCHF", 1000].to_usd == pytest.approx(120, abs=1e-6)


def test_as_of_never_looks_ahead(spark):
    t = START
    left = spark.createDataFrame([("a", t, 1), ("a", t + datetime.timedelta(hours=1), 2), ("b", t, 3)], "k string, ts timestamp, n int")
    quotes = spark.createDataFrame([("a", t, 5.0), ("a", t + datetime.timedelta(minutes=61), 9.0), ("b", t + datetime.timedelta(seconds=1), 7.0)], "k string, ts timestamp, v double")
    got = {r.n: r.x for r in C.as_of(left, quotes, ["k"], "v", "x").collect()}
    assert got == {1: 5.0, 2: 5.0, 3: None}


def test_crossed_quotes_are_refused(spark):
    bad = spark.createDataFrame([("buy", 1.0, 2.0, 1.0)], "side string, units double, bid double, ask double")
    with pytest.raises(Exception, match="crossed quote"):
        C.CostModel().price(bad).collect()
