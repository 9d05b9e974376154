"""Sealed dates, lineage, the ledger and reproducible experiments."""

from __future__ import annotations

import datetime
import importlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json, sha256_of
from ..sources.store import read_bars, read_ticks

SEAL = datetime.date(2025, 3, 1)


MODES = ("scoring", "mechanical")


class SealedError(PermissionError):
    """A request for dates that are held back."""


def as_date(value: Any) -> datetime.date:
    if isinstance(value, datetime.datetime):
        return value.date()
    return value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value)[:10])


def check_seal(dates: list[Any], cutoff: datetime.date = SEAL) -> None:
    """Refuse any date on or after the cutoff, whether or not there is data for it; nothing is trimmed."""
    held = sorted(d for d in map(as_date, dates) if d >= cutoff)
    if held:
        raise SealedError(f"{len(held)} dates from {held[0]} on are sealed (cutoff {cutoff})")


def unsealed(rows: DataFrame, cutoff: datetime.date = SEAL, ts: str = "ts") -> DataFrame:
    """Rows before the cutoff; reaches the scan as a pushed filter."""
    return rows.where(F.col(ts) < F.lit(cutoff.isoformat()).cast("timestamp"))


def sealed_files(ticks: DataFrame, cutoff: datetime.date = SEAL) -> DataFrame:
    """Files with any row on or after the cutoff."""
    return ticks.groupBy("file").agg(F.max(F.to_date("ts")).alias("last")).where(F.col("last") >= F.lit(cutoff))


@dataclass
class Loader:
    """Reads for one experiment, within allowed roots and before the seal; remembers what was served."""

    spark: SparkSession
    roots: tuple[str, ...]
    mode: str = "scoring"
    served: list[dict[str, Any]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise PermissionError(f"there is no mode {self.mode!r}; modes are {', '.join(MODES)}")

    def _root(self, root: str) -> str:
        real = str(Path(root).resolve()) if "://" not in root else root
        if not any(real == r or real.startswith(r.rstrip("/") + "/") for r in self.roots):
            raise PermissionError(f"{root} is not among the allowed roots")
        return root

    def ticks(self, root: str, pairs: list[str], first: str, last: str) -> DataFrame:
        if self.mode != "mechanical":
            check_seal([first, last])
        self.served.append({"what": "ticks", "root": self._root(root), "pairs": sorted(pairs), "first": first, "last": last})
        return read_ticks(self.spark, root, pairs, first, last)

    def bars(self, root: str, timeframe: str, pairs: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
        """Bars of a range of dates, or all.

        Dates are checked before anything is read, whether or not there are bars.
        Sealed bars within what is asked for are an error too, found by a filter
        that reaches the scan; nothing is trimmed.
        """
        if self.mode != "mechanical":
            check_seal([d for d in (first, last) if d])
        out = read_bars(self.spark, self._root(root), timeframe, pairs)
        if first:
            out = out.where(F.col("ts") >= F.lit(first).cast("timestamp"))
        if last:
            out = out.where(F.to_date("ts") <= F.lit(last).cast("date"))
        if self.mode != "mechanical" and not out.where(F.col("ts") >= F.lit(SEAL.isoformat()).cast("timestamp")).isEmpty():
            raise SealedError(f"the {timeframe} bars below {root} reach the sealed dates (cutoff {SEAL})")
        self.served.append({"what": "bars", "root": root, "timeframe": timeframe, "pairs": sorted(pairs)} | {k: v for k, v in (("first", first), ("last", last)) if v})
        return out


def append(ledger: str, record: dict[str, Any]) -> None:
    with open(ledger, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True, separators=(",", ":")) + "\n")
        f.flush()


@dataclass(frozen=True)
class Experiment:
    experiment_id: str
    taskcard: str
    entry: str  # module:function(params, seed, loader) -> dict
    seed: int
    mode: str = "scoring"
    params: dict[str, Any] = field(default_factory=dict)

    def function(self) -> Callable[[dict, int, Loader], dict]:
        module, _, name = self.entry.partition(":")
        return getattr(importlib.import_module(module), name)

    def document(self, payload: dict, served: list[dict]) -> dict:
        """What is hashed: the settings, the scope and the payload, and no clock and no path of output."""
        return {**asdict(self), "scope": served, "payload": payload}


def run_experiment(experiment: Experiment, loader: Loader, ledger: str, out: str) -> str:
    """Ledger start, run, result document, ledger end; returns the hash of the result."""
    now = lambda: datetime.datetime.now(datetime.UTC).isoformat()
    append(ledger, {"record": "start", "experiment_id": experiment.experiment_id, "taskcard": experiment.taskcard, "seed": experiment.seed, "mode": experiment.mode, "config_sha256": sha256_of(asdict(experiment)), "started_at": now()})
    end = {"record": "end", "experiment_id": experiment.experiment_id, "result_files": [], "result_hash": ""}
    try:
        document = experiment.document(experiment.function()(experiment.params, experiment.seed, loader), loader.served)
    except Exception as e:
        append(ledger, end | {"status": f"failed: {e}", "ended_at": now()})
        raise
    digest = sha256_of(document)
    Path(out).write_text(canonical_json(document), encoding="utf-8")
    append(ledger, end | {"status": "ok", "ended_at": now(), "result_files": [out], "result_hash": digest})
    return digest
