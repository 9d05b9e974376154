"""Job settings from TOML, checked when they are read."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from datetime import date, timedelta
from typing import Any

from ..functions.calendar import timeframe


class ConfigError(ValueError):
    """A setting that is unknown or out of range."""


def _pair(name: str) -> str:
    out = name.replace("_", "").replace("/", "").strip().upper()
    if len(out) != 6 or not out.isascii() or not out.isalpha():
        raise ConfigError(f"not a pair: {name!r}")
    return out


def _only(table: dict[str, Any], cls: type, where: str) -> dict[str, Any]:
    unknown = set(table) - {f.name for f in fields(cls)}
    if unknown:
        raise ConfigError(f"[{where}] has unknown settings: {', '.join(sorted(unknown))}")
    return table


@dataclass(frozen=True)
class IngestSettings:
    source: str = "folder"
    root: str = ""
    out: str = ""
    concurrency: int = 2
    checkpoint_every: int = 100
    fail_on_gap: bool = True
    timeframes: tuple[str, ...] = ("1min", "5min", "15min", "30min", "1h", "4h", "1D")
    requests: tuple[tuple[str, date, int], ...] = ()


@dataclass(frozen=True)
class CostSettings:
    commission_rate: float = 2e-05
    commission_min: float = 2.0
    cost_multiplier: float = 1.0


@dataclass(frozen=True)
class BacktestSettings:
    pairs: tuple[str, ...] = ()
    timeframe: str = "1h"
    fast: int = 6
    slow: int = 24
    units: float = 1_000_000.0
    initial_equity: float = 0.0
    costs: CostSettings = field(default_factory=CostSettings)


def requests(tables: dict[str, Any]) -> tuple[tuple[str, date, int], ...]:
    """``[[hours]]`` and ``[[range]]`` in order; exact repeats collapse."""
    out: dict[tuple[str, date, int], None] = {}
    for h in tables.get("hours", []):
        out[_pair(h["pair"]), date.fromisoformat(str(h["date"])), int(h["hour"])] = None
    for r in tables.get("range", []):
        first, last = (date.fromisoformat(str(r[k])) for k in ("first", "last"))
        if last < first:
            raise ConfigError(f"range ends on {last}, before {first}")
        for name in r["pairs"]:
            for d in range((last - first).days + 1):
                for hour in r.get("hours", range(24)):
                    out[_pair(name), first + timedelta(days=d), int(hour)] = None
    if any(not 0 <= h < 24 for _, _, h in out):
        raise ConfigError("hours are 0 to 23")
    return tuple(out)


def ingest_settings(text: str) -> IngestSettings:
    table = dict(tomllib.loads(text)["ingest"])
    asked = requests({k: table.pop(k) for k in ("hours", "range") if k in table})
    out = IngestSettings(**_only(table, IngestSettings, "ingest") | {"requests": asked, "timeframes": tuple(timeframe(t) for t in table.get("timeframes", IngestSettings.timeframes))})
    if not 1 <= out.concurrency <= 4:
        raise ConfigError("concurrency is 1 to 4")
    if not out.requests:
        raise ConfigError("no hours are asked for")
    return out


def backtest_settings(text: str) -> BacktestSettings:
    table = dict(tomllib.loads(text)["backtest"])
    costs = CostSettings(**_only(table.pop("costs", {}), CostSettings, "backtest.costs"))
    out = BacktestSettings(**_only(table, BacktestSettings, "backtest") | {"costs": costs, "pairs": tuple(map(_pair, table.get("pairs", ()))), "timeframe": timeframe(table.get("timeframe", "1h"))})
    if not 1 <= out.fast < out.slow:
        raise ConfigError("fast must be at least 1 and shorter than slow")
    if out.units <= 0 or min(costs.commission_rate, costs.commission_min, costs.cost_multiplier) < 0:
        raise ConfigError("units must be positive and costs not negative")
    return out
