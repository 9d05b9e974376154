"""Structured Streaming: bars from a quote stream, and a recorder into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.calendar import bucket_micros, micros
from ..operators.bars import HOUR, order_key
from ..schemas import QUOTES, STEPS, TICKS
from ..sources.feeds import two_sided
from ..sources.store import writers


def stream_bars(ticks: DataFrame, timeframe: str, lateness: str = "1 hour", seq: str = "seq") -> DataFrame:
    """Bars of a stream; a bar is emitted once the watermark has passed its end.

    State is one row per open (pair, bucket). Ticks later than ``lateness`` behind
    the newest are left out, as their bar is final.
    """
    width = micros(timeframe)
    at = bucket_micros(F.col("ts"), width)
    q = ticks.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "_spread": F.col("ask") - F.col("bid"), "_key": order_key(F.unix_micros("ts") - at, F.col(seq), ticks.schema[seq].dataType if width <= HOUR else None)})
    aggs = []
    for name in QUOTES:
        aggs += [F.min_by(name, "_key").alias(f"{name}_open"), F.max(name).alias(f"{name}_high"), F.min(name).alias(f"{name}_low"), F.max_by(name, "_key").alias(f"{name}_close")]
    grouped = q.withWatermark("ts", lateness).groupBy("pair", F.window("ts", f"{width // 1_000_000} seconds")).agg(*aggs, F.count(F.lit(1)).alias("tick_count"), F.avg("_spread").alias("spread_mean"), F.max("_spread").alias("spread_max"))
    return grouped.select("pair", F.col("window.start").alias("ts"), *[f"{n}_{s}" for n in QUOTES for s in STEPS], "tick_count", "spread_mean", "spread_max")


def recorder(ticks: DataFrame, out: str, checkpoint: str, rows_per_file: int = 50_000, every: str = "60 seconds") -> DataStreamWriter:
    """A writer that records two-sided quotes by pair, date and hour, so that a file never goes on into another hour.

    The trigger bounds the time until a file is there and ``rows_per_file`` its
    size; the file sink and the checkpoint make it exactly once across crashes.
    Start it with ``.start()``, or end with the data by ``.trigger(availableNow=True)``.
    """
    rows = two_sided(ticks).select(*TICKS.names).withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    rows = rows.repartition(writers(ticks.sparkSession), "pair", "date", "hour")
    return rows.writeStream.format("parquet").partitionBy("pair", "date", "hour").option("path", out).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file).trigger(processingTime=every)


def sorted_recorder(ticks: DataFrame, out: str, checkpoint: str, every: str = "60 seconds") -> DataStreamWriter:
    """A recorder whose files are sorted by time, each of one hour.

    Each micro-batch replaces a folder of its own, so that a batch that is run
    again after a crash leaves its ticks once. Instants are integer microseconds.
    """
    rows = two_sided(ticks).select(*TICKS.names).withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})

    def write(batch: DataFrame, number: int) -> None:
        dealt = batch.repartition(writers(batch.sparkSession), "pair", "date", "hour").sortWithinPartitions("pair", "date", "hour", "ts")
        dealt.write.mode("overwrite").partitionBy("pair", "date", "hour").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)
