"""Operators against plain Python on many random series at once: every series is a pair of its own."""

from __future__ import annotations

import bisect
import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import costs as C
from tickloom.operators import coverage as V
from tickloom.operators import manifest as M
from tickloom.operators import quality as Q

DAY0 = datetime.date(2024, 1, 1)
KINDS = ["data", "data", "data", "empty", "missing", "unprobed"]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    out = {}
    for k in range(60):
        weights = [rng.random() + 0.05 for _ in KINDS]
        out[f"P{k:05d}"] = rng.choices(KINDS, weights, k=rng.randint(1, 60))
    return out


@pytest.fixture(scope="module")
def days(spark, cases):
    rows = [(p, DAY0 + datetime.timedelta(days=i), kind, i) for p, kinds in cases.items() for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "pair string, date date, kind string, i int")


def start_of(kinds, fraction, window):
    probed = [(i, k == "data") for i, k in enumerate(kinds) if k != "unprobed"]
    for at, (i, flag) in enumerate(probed):
        near, far = [f for _, f in probed[at : at + window]], [f for _, f in probed[at:]]
        if flag and sum(near) / len(near) >= fraction and sum(far) / len(far) >= fraction:
            return i
    return None


def holes_of(kinds, least, since):
    out, run = [], []
    for i, k in [*enumerate(kinds), (len(kinds), "data")]:
        if since is not None and i < since:
            continue
        if k == "data":
            if len(run) >= least:
                out.append((run[0], run[-1]))
            run = []
        else:
            run.append(i)
    return out


@pytest.mark.parametrize(("fraction", "window", "least"), [(0.5, 5, 2), (0.7, 3, 1), (0.3, 10, 4)])
def test_coverage(cases, days, fraction, window, least):
    starts = V.recommended_start(days, fraction, window)
    got = {r.pair: r.start for r in starts.collect()}
    want = {p: start_of(k, fraction, window) for p, k in cases.items()}
    assert got == {p: None if i is None else DAY0 + datetime.timedelta(days=i) for p, i in want.items()}
    found = {}
    holes = V.holes(days, least, starts)
    for r in holes.collect():
        found.setdefault(r.pair, []).append((r.first_i, r.last_i))
        assert sum(r.composition.values()) == r.trading_days == r.last_i - r.first_i + 1
    assert {p: sorted(v) for p, v in found.items()} == {p: h for p, k in cases.items() if (h := holes_of(k, least, want[p]))}
    targets = {}
    for r in V.refine_targets(days, starts, holes, (9, 11), 2, 13).collect():
        targets.setdefault(r.pair, set()).add(((r.date - DAY0).days, r.hour))
    for p, kinds in cases.items():
        wanted = [] if want[p] is None else list(range(max(0, want[p] - 2), min(len(kinds), want[p] + 3)))
        for a, b in holes_of(kinds, least, want[p]):
            wanted += [i for i in (a - 1, a, (a + b) // 2, b, b + 1) if 0 <= i < len(kinds)]
        wanted = [(i, h) for i in dict.fromkeys(wanted) for h in (9, 11)][:13]
        assert targets.get(p, set()) == set(wanted)


@pytest.mark.parametrize("count", [1, 2, 4, 7])
def test_quality_targets(cases, days, count):
    got = {}
    for r in V.quality_targets(days.withColumn("hour", F.lit(13)), count).collect():
        got.setdefault(r.pair, []).append((r.date - DAY0).days)
    for p, kinds in cases.items():
        data = [i for i, k in enumerate(kinds) if k == "data"]
        if not data:
            assert p not in got
            continue
        picked = [0] if count <= 1 else sorted({int(round(i * ((len(data) - 1) / (count - 1)))) for i in range(count)})
        assert sorted(got[p]) == [data[i] for i in picked]


def test_outliers_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(f"P{k}", DAY0 + datetime.timedelta(days=i), rng.choice([3, 20, 24, 24]), int(rng.choice([1, 1, 1, 6, 0.1]) * rng.randint(80, 120))) for k in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "pair string, date date, hours_ok long, ticks long")
    got = {(r.pair, r.date): r.tick_count_outlier for r in M.tick_count_outliers(df).collect()}
    past: dict[str, list[int]] = {}
    for p, d, ok, n in rows:
        before = past.setdefault(p, [])
        far = ok >= 20 and len(before) >= 3 and (m := statistics.median(before)) > 0 and not 0.25 * m <= n <= 4 * m
        assert got[p, d] == far
        if ok >= 20 and n > 0:
            before.append(n)


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(4)
    t0 = datetime.datetime(2024, 3, 8, 21, tzinfo=datetime.UTC)
    rows = []
    for k in range(12):
        for s in range(rng.randint(1, 300)):
            at = t0 + datetime.timedelta(milliseconds=rng.choice([rng.randint(0, 200_000_000), rng.randint(0, 20) * 1000]))
            bid = rng.randint(100_000, 100_400) / 100_000
            rows.append((f"P{k}", at, bid, bid + rng.randint(0, 9) / 100_000, float(rng.randint(1, 2)), 1.0, s))
    return rows, spark.createDataFrame(rows, "pair string, ts timestamp, bid double, ask double, bid_volume double, ask_volume double, seq long")


@pytest.mark.parametrize(("fine", "coarse"), [("1min", "15min"), ("5min", "4h"), ("30min", "1D"), ("1h", "1D")])
def test_roll_up_equals_direct(ticks, fine, coarse):
    _, df = ticks
    direct = {(r.pair, r.ts): r for r in B.bars(df, coarse).collect()}
    rolled = {(r.pair, r.ts): r for r in B.roll_up(B.bars(df, fine), coarse).collect()}
    assert direct.keys() == rolled.keys()
    for k, a in direct.items():
        for c in a.asDict():
            assert rolled[k][c] == (pytest.approx(a[c], rel=1e-12) if c == "spread_mean" else a[c])


def test_bars_against_a_loop(ticks):
    rows, df = ticks
    got = {(r.pair, r.ts.replace(tzinfo=datetime.UTC)): r for r in B.bars(df, "5min").collect()}
    groups: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[6])):
        groups.setdefault((r[0], datetime.datetime.fromtimestamp(r[1].timestamp() // 300 * 300, datetime.UTC)), []).append(r)
    assert got.keys() == groups.keys()
    for k, g in groups.items():
        bids = [r[2] for r in g]
        assert (got[k].bid_open, got[k].bid_high, got[k].bid_low, got[k].bid_close, got[k].tick_count) == (bids[0], max(bids), min(bids), bids[-1], len(g))


def test_dedup_keeps_first_occurrences(spark, ticks):
    rows, df = ticks
    hour = df.withColumn("hour_start", F.date_trunc("hour", "ts"))
    twice = hour.unionByName(hour.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1000))
    kept = {(r.pair, r.ts, r.bid, r.ask, r.bid_volume): r.seq for r in Q.dedup(twice).collect()}
    first: dict[tuple, int] = {}
    for r in df.collect():
        key = (r.pair, r.ts, r.bid, r.ask, r.bid_volume)
        first[key] = min(first.get(key, r.seq), r.seq)
    assert kept == first
    counts = Q.dedup_counts(twice).agg(F.sum("decoded"), F.sum("kept"), F.sum("dropped")).first()
    assert counts[0] == twice.count()
    assert counts[1] == len(first)
    assert counts[2] == counts[0] - counts[1]


@pytest.mark.parametrize("bucket", [7_000_000, 86_400_000_000])
def test_as_of_against_bisection(spark, bucket):
    rng = random.Random(9)
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    quotes = {(k, t): rng.random() for k in "abc" for t in rng.sample(range(200), 60)}
    left = [(rng.choice("abcd"), rng.randrange(220), n) for n in range(400)]
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    q = spark.createDataFrame([(k, at(t), v) for (k, t), v in quotes.items()], "k string, ts timestamp, v double")
    got = {r.n: r.x for r in C.as_of(spark.createDataFrame([(k, at(t), n) for k, t, n in left], "k string, ts timestamp, n int"), q, ["k"], "v", "x", bucket).collect()}
    times = {k: sorted(t for kk, t in quotes if kk == k) for k in "abcd"}
    for k, t, n in left:
        i = bisect.bisect_right(times[k], t)
        assert got[n] == (quotes[k, times[k][i - 1]] if i else None)
