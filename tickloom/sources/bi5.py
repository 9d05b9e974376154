"""Hourly tick files: LZMA blocks of 20-byte big-endian records.

A record is milliseconds in the hour, ask and bid in points, and the two volumes.
Files are scanned as ``binaryFile`` and decoded in Arrow batches; a file that
can't be decoded is a row with an error, not a failed job.
"""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.pairs import divisor
from ..session import ship_package

RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
FILE = r"([A-Z]{6})_(\d{4}-\d{2}-\d{2})_(\d{2})h\.bi5$"
SCHEMA = "pair string, date string, hour int, seq bigint, ms bigint, ask_i bigint, bid_i bigint, ask_volume double, bid_volume double, error string"


class DecodeError(ValueError):
    """Bytes that are no hour of ticks."""


def decompress(block: bytes) -> bytes:
    """LZMA in the stand-alone format; no bytes stay no bytes."""
    if not block:
        return b""
    try:
        return lzma.decompress(block, format=lzma.FORMAT_ALONE)
    except lzma.LZMAError as e:
        raise DecodeError(f"no LZMA block ({e}); first bytes {block[:8].hex()}, {len(block)} in all") from e


def decode_records(raw: bytes) -> np.ndarray:
    if len(raw) % RECORD.itemsize:
        raise DecodeError(f"{len(raw)} bytes are no whole records of {RECORD.itemsize}")
    return np.frombuffer(raw, RECORD)


def encode_hour(records: np.ndarray) -> bytes:
    """A file's bytes, for tests and fixtures; no records make an empty file."""
    return lzma.compress(records.astype(RECORD).tobytes(), format=lzma.FORMAT_ALONE, preset=0) if len(records) else b""


def _rows(path: str, content: bytes) -> pa.RecordBatch:
    m = re.search(FILE, path)
    pair, date, hour = (m[1], m[2], int(m[3])) if m else (None, None, None)
    error, records = None, np.zeros(0, RECORD)
    try:
        records = decode_records(decompress(content))
    except DecodeError as e:
        error = f"DECODE_ERROR: {e}"
    n = len(records)
    k = n or 1  # an hour without ticks is one row without a record, so that it isn't lost

    def column(name: str, kind: pa.DataType, to: str) -> pa.Array:
        return pa.array(records[name].astype(to), kind) if n else pa.nulls(1, kind)

    return pa.RecordBatch.from_arrays(
        [pa.array([pair] * k, pa.string()), pa.array([date] * k, pa.string()), pa.array([hour] * k, pa.int32()), pa.array(np.arange(n), pa.int64()) if n else pa.nulls(1, pa.int64()),
         column("ms", pa.int64(), "i8"), column("ask", pa.int64(), "i8"), column("bid", pa.int64(), "i8"), column("ask_volume", pa.float64(), "f8"), column("bid_volume", pa.float64(), "f8"), pa.array([error] * k, pa.string())],
        ["pair", "date", "hour", "seq", "ms", "ask_i", "bid_i", "ask_volume", "bid_volume", "error"],
    )


def decode_files(files: DataFrame) -> DataFrame:
    """Raw records of a ``binaryFile`` frame; empty and broken files give one row without a record."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _rows(path, content)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def scale(records: DataFrame) -> DataFrame:
    """Prices and instants of raw records, as native columns: points divided by the pair's divisor."""
    start = F.to_timestamp(F.format_string("%s %02d:00:00", "date", "hour"))
    d = divisor(F.col("pair"))
    return records.withColumns({"hour_start": start, "ts": F.timestamp_micros(F.unix_micros(start) + F.col("ms") * 1000), "bid": F.col("bid_i") / d, "ask": F.col("ask_i") / d})


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bi5").option("recursiveFileLookup", "true").load(root)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Decoded hours below a folder: one row per tick, or one row without a record per broken file."""
    return scale(decode_files(binary_files(spark, root)))


def hour_files(spark: SparkSession, root: str, digest: bool = False) -> DataFrame:
    """``pair, date, hour, path, length`` of every file below a folder, those without bytes included.

    Spark's scans skip files without bytes, so names come from its file index,
    which the driver holds anyway, and lengths (and digests) from the scan.
    """
    files = binary_files(spark, root)
    names = [(n,) for n in files.inputFiles() if n]
    x = F.regexp_extract

    def key(df: DataFrame) -> DataFrame:
        return df.select(x("path", FILE, 1).alias("pair"), x("path", FILE, 2).cast("date").alias("date"), x("path", FILE, 3).cast("int").alias("hour"), *[c for c in df.columns if c != "content"])

    scanned = key(files.select("path", "length", *([F.sha2("content", 256).alias("sha256")] if digest else []))).drop("path")
    every = key(spark.createDataFrame(names, "path string"))
    return every.join(scanned, ["pair", "date", "hour"], "left").na.fill(0, ["length"])


def availability(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested hours with ``present``, ``empty`` or ``missing``; file contents are not read."""
    kind = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty").otherwise("present")
    return requests.join(files, ["pair", "date", "hour"], "left").select("pair", "date", "hour", kind.alias("availability"), F.coalesce("length", F.lit(0)).cast("long").alias("bytes"))


class Bi5Partition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Bi5Reader(DataSourceReader):
    """Reads files of a mounted folder, some per partition; stores that only Spark reads go through ``scan``."""

    FILES = 64

    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        paths = sorted(map(str, Path(self.root).rglob("*.bi5")))
        return [Bi5Partition(paths[i : i + self.FILES]) for i in range(0, len(paths), self.FILES)] or [Bi5Partition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with open(path, "rb") as f:
                yield _rows(path, f.read())


class Bi5DataSource(DataSource):
    """``spark.read.format("bi5").load(folder)`` after ``spark.dataSource.register(Bi5DataSource)``."""

    @classmethod
    def name(cls) -> str:
        return "bi5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Bi5Reader(self.options)
