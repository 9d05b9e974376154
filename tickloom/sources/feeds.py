"""Where hours and live quotes come from: interfaces, offline forms and the factory.

Nothing here opens a connection by itself: a transport is a function that the
caller supplies, so tests and jobs without a network run the same code.
"""

from __future__ import annotations

import http.client
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Statuses after which a request is made again, and those with a meaning of their own.
RETRY = frozenset({408, 425, 429, 500, 502, 503, 504})
MISSING, FORBIDDEN = 404, 403


class SourceError(RuntimeError):
    """An hour that could not be had."""


class Throttled(SourceError):
    """An hour that may yet be had: the feed was busy or could not be reached."""


class OfflineError(SourceError):
    """A request where none is allowed."""


@dataclass(frozen=True)
class RawHour:
    content: bytes
    origin: str
    availability: str  # present, empty or missing


class HourSource(Protocol):
    def fetch(self, pair: str, day: date, hour: int) -> RawHour: ...


def _raw(content: bytes, origin: str) -> RawHour:
    return RawHour(content, origin, "present" if content else "empty")


@dataclass(frozen=True)
class FolderSource:
    """Files ``PAIR_DATE_HHh.bi5`` of a folder; an absent file is missing, one without bytes empty."""

    root: str

    def fetch(self, pair: str, day: date, hour: int) -> RawHour:
        path = Path(self.root) / f"{pair}_{day.isoformat()}_{hour:02d}h.bi5"
        return _raw(path.read_bytes(), str(path)) if path.exists() else RawHour(b"", str(path), "missing")


@dataclass(frozen=True)
class BlockedSource:
    def fetch(self, pair: str, day: date, hour: int) -> RawHour:
        raise OfflineError(f"{pair} {day} {hour:02d}h: this job may not use the network")


@dataclass(frozen=True)
class HttpSource:
    """Requests through ``get(url) -> (status, bytes)``, again after a growing pause where that can help.

    Statuses that may pass and faults of the transport are tried again; the pause
    doubles up to ``longest_pause``.
    """

    get: Callable[[str], tuple[int, bytes]]
    base: str
    attempts: int = 5
    pause: float = 1.0
    longest_pause: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def url(self, pair: str, day: date, hour: int) -> str:
        return f"{self.base}/{pair}/{day.year:04d}/{day.month - 1:02d}/{day.day:02d}/{hour:02d}h_ticks.bi5"

    def fetch(self, pair: str, day: date, hour: int) -> RawHour:
        url, last, fault = self.url(pair, day, hour), "", Throttled
        for attempt in range(self.attempts):
            if attempt:
                self.sleep(min(self.pause * 2 ** (attempt - 1), self.longest_pause))
            try:
                status, content = self.get(url)
            except (OSError, http.client.HTTPException) as e:
                last = f"{type(e).__name__}: {e}"
                continue
            last = f"status {status}"
            if status == 200:
                return _raw(content, url)
            if status == MISSING:
                return RawHour(b"", url, "missing")
            if status not in RETRY:
                fault = SourceError
                break
        raise fault(f"{url}: {last}")


def build_source(mode: str, *, root: str = "", get: Callable[[str], tuple[int, bytes]] | None = None, base: str = "") -> HourSource:
    """``folder``, ``http`` or ``blocked``."""
    if mode == "folder":
        return FolderSource(root)
    if mode == "http" and get:
        return HttpSource(get, base)
    if mode == "blocked":
        return BlockedSource()
    raise ValueError(f"unknown source {mode!r}, or one without its transport")


# What a candle source may be asked for, and fragments that would move money.
ALLOWED_ENDS, FORBIDDEN_PARTS = ("/candles", "/instruments"), ("/orders", "/trades", "/positions", "/transactions", "/pricing/stream")


@dataclass(frozen=True)
class CandleSource:
    """Candles through ``get(url) -> (status, bytes)``; only the read-only addresses are let through."""

    get: Callable[[str], tuple[int, bytes]]
    base: str

    def check(self, path: str) -> str:
        plain = path.split("?")[0].lower()
        if any(p in plain for p in FORBIDDEN_PARTS) or not plain.endswith(ALLOWED_ENDS):
            raise PermissionError(f"{plain} may not be requested")
        return f"{self.base}{path}"

    def candles(self, pair: str, first: str, last: str, granularity: str = "H1") -> bytes:
        """The JSON answer, to be landed and read by ``logs.read_candles``."""
        path = f"/v3/instruments/{pair[:3]}_{pair[3:]}/candles?price=BAM&granularity={granularity}&from={first}&to={last}"
        status, content = self.get(self.check(path))
        if status != 200:
            raise SourceError(f"{path}: status {status}")
        return content


def replay_rows(ticks: DataFrame, pairs: list[str], limit: int | None = None) -> DataFrame:
    """The subscribed pairs' ticks in time; the first ``limit`` if asked for."""
    rows = ticks.where(F.col("pair").isin(*pairs)).orderBy("ts", *[c for c in ("file", "row", "seq") if c in ticks.columns])
    return rows if limit is None else rows.limit(limit)


def replay(spark: SparkSession, path: str, pairs: list[str], files_per_trigger: int = 1) -> DataFrame:
    """A stored tick table as a stream of the subscribed pairs."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).where(F.col("pair").isin(*pairs))


def two_sided(quotes: DataFrame) -> DataFrame:
    """Quotes with both sides; live feeds also send one-sided ones."""
    return quotes.where("bid > 0 and ask > 0")


def land(source: HourSource, requests: Iterator[tuple[str, date, int]], folder: str) -> Iterator[tuple[str, date, int, str]]:
    """Fetch hours one by one into a folder that Spark can scan; yields what each request came to."""
    for pair, day, hour in requests:
        try:
            raw = source.fetch(pair, day, hour)
        except SourceError as e:
            yield pair, day, hour, f"FETCH_ERROR: {e}"
            continue
        if raw.availability != "missing":
            part = Path(folder) / f".{pair}_{day}_{hour:02d}h.part"
            part.write_bytes(raw.content)
            part.rename(Path(folder) / f"{pair}_{day.isoformat()}_{hour:02d}h.bi5")
        yield pair, day, hour, raw.availability
