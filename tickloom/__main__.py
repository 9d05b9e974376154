"""Commands: ``python -m tickloom ingest | bars | backtest | crosscheck | report | survey | experiment``.

Each returns 0 when all is well, 1 when the job ran and found a fault or failed, 2
for settings that can't be used, and 3 where its input isn't there.
"""

from __future__ import annotations

import argparse
import sys
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.calendar import TimeframeError
from .operators import backtest as T
from .operators import crosscheck as X
from .operators import reports as R
from .operators.bars import bars as make_bars
from .operators.costs import CostModel
from .plans import incremental, research
from .plans.ingest import ingest_in_steps
from .session import build_session
from .sources import config, logs, requests, store

OK, FAULT, SETTINGS, ABSENT = 0, 1, 2, 3


def say(text: str) -> None:
    print(text, file=sys.stderr)


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Ingest what the settings ask for, below ``root``, and bring the bars up to date."""
    s = config.ingest_settings(Path(a.config).read_text(encoding="utf-8"))
    if s.source != "folder":
        raise config.ConfigError(f"hours are read from a folder; land those of source {s.source!r} there first")
    asked = spark.createDataFrame(list(s.requests), "pair string, date date, hour int")
    manifest = f"{s.out}/manifest"
    errors = hours = 0
    for rows in ingest_in_steps(spark, s.root, asked, s.out, manifest, fail_on_gap=s.fail_on_gap):
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("e"), F.sum("written_ticks").alias("ticks")).first()
        hours, errors = hours + r["n"], errors + r["e"]
        say(f"{r['n']:,} hours, {r['ticks']:,} ticks, {r['e']:,} with errors")
        for line in R.reason_lines(rows.select(F.explode("issues").alias("i")).select("i.reason", "i.count")):
            say(f"  {line}")
    if store._exists(spark, f"{s.out}/ticks"):
        built = incremental.build_bars(spark, s.out, list(s.timeframes))
        say(f"{built.count():,} days of bars built")
    print(f"{hours} hours, {errors} errors")
    return FAULT if errors else OK


def bars(spark: SparkSession, a: argparse.Namespace) -> int:
    """Build the bars of days whose files changed."""
    if not store._exists(spark, f"{a.store}/ticks"):
        say(f"no ticks below {a.store}")
        return ABSENT
    print(f"{incremental.build_bars(spark, a.store, a.timeframes.split(',')).count()} days built")
    return OK


def backtest(spark: SparkSession, a: argparse.Namespace) -> int:
    """The moving-average rule over stored bars; writes the result as JSON lines and prints its summary."""
    s = config.backtest_settings(Path(a.config).read_text(encoding="utf-8"))
    rows = store.read_bars(spark, a.store, s.timeframe, list(s.pairs))
    without = sorted(set(s.pairs) - {r["pair"] for r in rows.select("pair").distinct().collect()})
    if without:
        raise LookupError(f"no {s.timeframe} bars of {', '.join(without)} below {a.store}")
    aimed = T.moving_average_target(rows, s.fast, s.slow, s.units)
    done = T.executions(aimed, CostModel(s.costs.commission_rate, s.costs.commission_min, s.costs.cost_multiplier))
    round_trips, curve = T.trades(done), T.equity(aimed, done, s.initial_equity)
    total = T.summary(aimed, round_trips, curve)
    if a.out:
        R.result_document(round_trips, curve, total).write.mode("overwrite").partitionBy("part").text(a.out)
    print(total.toJSON().first())
    return OK


def crosscheck(spark: SparkSession, a: argparse.Namespace) -> int:
    """Stored hours against another source's landed candles."""
    if not store._exists(spark, a.candles):
        say(f"no candles at {a.candles}")
        return ABSENT
    pairs = a.pair or None
    ticks = store.read_ticks(spark, a.store, pairs)
    diffs = X.differences(make_bars(ticks, "1h", "row"), logs.read_candles(spark, a.candles).where("complete"))
    found = X.describe(diffs)
    print(R.document("Cross-check", {"store": a.store, "candles": a.candles, "pips allowed": a.most}, [("Differences", found.orderBy("pair")), ("Flagged", X.flagged(diffs, a.most).orderBy("pair", "ts"))]))
    return FAULT if not X.flagged(diffs, a.most).isEmpty() else OK


def _deliver(text: str, out: str | None) -> int:
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        print(text)
    return OK


def report(spark: SparkSession, a: argparse.Namespace) -> int:
    """The ingestion report of a store and its manifest."""
    hours = store.read_stored_manifest(spark, f"{a.store}/manifest")
    if hours is None:
        say(f"no manifest below {a.store}")
        return ABSENT
    has = lambda part: store._exists(spark, f"{a.store}/{part}")
    made = spark.read.parquet(f"{a.store}/bars") if has("bars") else None
    stored = store.footprint(store.files(spark, f"{a.store}/ticks")) if has("ticks") else None
    sessions = logs.read_sessions(spark, a.sessions) if a.sessions else None
    sections = R.ingest_sections(hours, store.read_ticks(spark, a.store), made, stored, sessions)
    return _deliver(R.document("Ingestion", {"store": a.store, "sessions": a.sessions}, sections), a.out)


def survey(spark: SparkSession, a: argparse.Namespace) -> int:
    """The coverage report of a probe log; later lines of the log replace earlier ones of their hour."""
    if not store._exists(spark, a.probes):
        say(f"no probes at {a.probes}")
        return ABSENT
    line = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())  # ids grow within a split only
    probes = logs.read_probes(spark, a.probes).withColumns({"date": F.col("date").cast("date"), "line_no": line})
    pairs = a.pairs.split(",")
    calendar = requests.pair_calendar(spark, pairs, requests.trading_days(spark, a.first, a.last, a.hour))
    ledger = logs.read_ledger(spark, a.ledger) if a.ledger else None
    return _deliver(R.document("Coverage", {"probes": a.probes, "days": f"{a.first} to {a.last}", "hour": a.hour}, R.survey_sections(calendar, probes, a.hour, ledger=ledger)), a.out)


def experiment(spark: SparkSession, a: argparse.Namespace) -> int:
    """Run an experiment by its settings; ``--reproduce`` leaves the ledger alone. Prints the hash of the result."""
    table = tomllib.loads(Path(a.config).read_text(encoding="utf-8"))
    roots, ledger = tuple(str(Path(r).resolve()) for r in table.pop("roots", [])), table.pop("ledger", None)
    try:
        e = research.Experiment(**table)
    except TypeError as err:
        raise config.ConfigError(str(err)) from err
    loader = research.Loader(spark, roots, e.mode)
    if a.reproduce:
        digest = research.sha256_of(e.document(e.function()(e.params, e.seed, loader), loader.served))
    elif ledger:
        digest = research.run_experiment(e, loader, ledger, a.out or str(Path(a.config).parent / "result.json"))
    else:
        raise config.ConfigError("an experiment needs a ledger")
    print(f"RESULT_HASH {digest}")
    return OK


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m tickloom", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(run: Callable[[SparkSession, argparse.Namespace], int], *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__, help=(run.__doc__ or "").splitlines()[0])
        p.set_defaults(run=run)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        return p

    command(ingest, "config")
    command(bars, "store").add_argument("--timeframes", default="1min,5min,15min,30min,1h,4h,1D")
    command(backtest, "config", "store").add_argument("--out")
    p = command(crosscheck, "store", "candles")
    p.add_argument("--pair", action="append")
    p.add_argument("--most", type=float, default=1.0)
    p = command(report, "store")
    p.add_argument("--sessions")
    p.add_argument("--out")
    p = command(survey, "probes", "pairs", "first", "last")
    p.add_argument("--hour", type=int, default=13)
    p.add_argument("--ledger")
    p.add_argument("--out")
    p = command(experiment, "config")
    p.add_argument("--reproduce", action="store_true")
    p.add_argument("--out")
    return parser


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    try:
        return a.run(build_session(), a)
    except (config.ConfigError, TimeframeError, tomllib.TOMLDecodeError, KeyError) as e:
        say(f"settings: {e}")
        return SETTINGS
    except (LookupError, FileNotFoundError) as e:
        say(str(e))
        return ABSENT
    except (research.SealedError, PermissionError, ValueError) as e:
        say(f"{type(e).__name__}: {e}")
        return FAULT


if __name__ == "__main__":
    sys.exit(main())
