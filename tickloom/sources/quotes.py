"""Live quotes as a stream: a spool that a subscription appends to, and the data source that reads it.

A subscription can't be asked for a quote twice, so what it sends goes to the
spool first. The stream's offsets count the spool's quotes by pair, so a batch that
is run again, on whatever executor, reads the same rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schemas import TICKS
from ..session import ship_package

#: One quote of the spool; a side that wasn't sent is 0.
QUOTE = np.dtype([("ts", "<i8"), ("bid", "<f8"), ("ask", "<f8"), ("bid_volume", "<f8"), ("ask_volume", "<f8")])
SLICE = 1 << 20


class Spool:
    """A file of fixed-size records for each pair, in a folder that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, pair: str) -> str:
        return os.path.join(self.folder, f"{pair}.quotes")

    def append(self, pair: str, quotes: Iterable[tuple[int, float | None, float | None, float | None, float | None]]) -> int:
        """Add quotes (microseconds, bid, ask and their volumes) and return how many there are now.

        A record that a crash cut off is written over.
        """
        rows = np.array([tuple(0 if v is None else v for v in q) for q in quotes], QUOTE)
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        n = self.latest(pair)
        with open(self._path(pair), "r+b" if os.path.exists(self._path(pair)) else "w+b") as f:
            f.seek(n * QUOTE.itemsize)
            f.write(rows.tobytes())
            f.flush()
            os.fsync(f.fileno())
        return n + len(rows)

    def latest(self, pair: str) -> int:
        """Whole quotes of the pair so far."""
        return os.path.getsize(self._path(pair)) // QUOTE.itemsize if os.path.exists(self._path(pair)) else 0

    def read(self, pair: str, first: int, last: int) -> np.ndarray:
        with open(self._path(pair), "rb") as f:
            f.seek(first * QUOTE.itemsize)
            return np.frombuffer(f.read((last - first) * QUOTE.itemsize), QUOTE)


def subscribe(quotes: Iterable[tuple[str, int, float | None, float | None, float | None, float | None]], folder: str, pairs: Iterable[str], flush_every: int = 100) -> dict[str, int]:
    """Spool the quotes of the asked pairs until the subscription ends; returns the quotes by pair.

    At most ``flush_every`` quotes are in memory and not yet in the spool.
    """
    spool, wanted, held, n = Spool(folder), set(pairs), {}, 0
    done = {p: spool.latest(p) for p in wanted}

    def flush() -> None:
        for pair, rows in held.items():
            done[pair] = spool.append(pair, rows)
        held.clear()

    try:
        for pair, *quote in quotes:
            if pair in wanted:
                held.setdefault(pair, []).append(tuple(quote))
                n += 1
                if n % flush_every == 0:
                    flush()
    finally:
        flush()
    return done


class SpoolPart(InputPartition):
    def __init__(self, pair: str, first: int, last: int):
        self.pair, self.first, self.last = pair, first, last


class SpoolReader(DataSourceStreamReader):
    """Offsets are quotes by pair; a partition is at most ``SLICE`` quotes of one pair."""

    def __init__(self, options: dict):
        self.spool = Spool(options["path"])
        self.pairs = [p for p in options.get("pairs", "").split(",") if p]
        if not self.pairs:
            raise ValueError("option pairs names the pairs, joined by commas")

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.pairs, 0)

    def latestOffset(self) -> dict:
        return {p: self.spool.latest(p) for p in self.pairs}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [SpoolPart(p, i, min(i + SLICE, end[p])) for p in self.pairs for i in range(start.get(p, 0), end.get(p, 0), SLICE)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        q = self.spool.read(partition.pair, partition.first, partition.last)
        n = len(q)
        ts = pa.array(q["ts"].copy(), pa.int64()).cast(pa.timestamp("us", tz="UTC"))
        sides = [pa.array(q[c].copy()) for c in ("bid", "ask", "bid_volume", "ask_volume")]
        yield pa.RecordBatch.from_arrays([pa.repeat(partition.pair, n), ts, *sides, pa.repeat("live", n)], names=["pair", *QUOTE.names, "source"])


class SpoolDataSource(DataSource):
    """``spark.readStream.format("quotes").option("pairs", "EURUSD,USDJPY").load(folder)`` after ``live_quotes`` or a registration."""

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return str(TICKS)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SpoolReader(self.options)


def live_quotes(spark: SparkSession, folder: str, pairs: Iterable[str]) -> DataFrame:
    """The spooled quotes of these pairs as a stream; one-sided ones too (``feeds.two_sided`` drops them)."""
    ship_package(spark)
    spark.dataSource.register(SpoolDataSource)
    return spark.readStream.format("quotes").option("pairs", ",".join(pairs)).load(folder)
