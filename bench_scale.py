"""Ticks per second of the tick operators on generated ticks, as one line of JSON.

``SCALE_TICKS`` (default 20 million) ticks of twelve pairs, a third of them of one
pair, over a year, are written once to a temporary store; each operator then reads
them from Parquet and its result is consumed whole.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def measure(spark, n: int, only: tuple[str, ...] = ()) -> dict[str, int]:
    """Ticks a second of each operator, or of those named, over ``n`` generated ticks."""
    from pyspark.sql import functions as F

    from tickloom.functions.calendar import TIMEFRAMES, market_open, session_label
    from tickloom.functions.pairs import UNIVERSE, divisor
    from tickloom.operators import bars as B
    from tickloom.operators import manifest as M
    from tickloom.operators import quality as Q

    root = tempfile.mkdtemp(prefix="scale-")
    i, mix = F.col("id"), F.xxhash64("id")
    which = F.when(F.pmod(mix, F.lit(3)) == 0, F.lit(1)).otherwise(F.pmod(F.shiftright(mix, 8), F.lit(len(UNIVERSE))).cast("int") + 1)
    pair = F.element_at(F.array(*map(F.lit, UNIVERSE)), which)
    ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (i * (365 * 86_400_000_000 // n)))
    t = spark.range(n).select(pair.alias("pair"), ts.alias("ts"), i.cast("int").alias("seq"), (F.lit(110_000) + F.pmod(F.shiftright(mix, 16), F.lit(400))).alias("bid_i"), F.pmod(F.shiftright(mix, 32), F.lit(9)).alias("s"))
    t = t.select("pair", "ts", "seq", (F.col("bid_i") / divisor(F.col("pair"))).alias("bid"), ((F.col("bid_i") + F.col("s")) / divisor(F.col("pair"))).alias("ask"), F.lit(1.0).alias("bid_volume"), F.lit(2.0).alias("ask_volume"))
    t.write.parquet(f"{root}/ticks")
    ticks = spark.read.parquet(f"{root}/ticks")
    hours = ticks.withColumn("hour_start", F.date_trunc("hour", "ts"))
    work = {
        "bars_1min": lambda: B.bars(ticks, "1min"),
        "bars_1h": lambda: B.bars(ticks, "1h"),
        "bars_seven_timeframes": lambda: B.bars_of_timeframes(ticks, list(TIMEFRAMES)),
        "market_open_and_session": lambda: ticks.where(market_open(F.col("ts"))).groupBy(session_label(F.col("ts"))).count(),
        "dedup": lambda: Q.dedup(hours),
        "validate": lambda: Q.issues(hours),
        "spread_by_hour": lambda: Q.spread_stats(hours, ["pair", "hour_start"]),
        "spread_by_session": lambda: M.spread_by_session(ticks),
    }
    out = {}
    for name, make in work.items():
        if only and name not in only:
            continue
        make().limit(1).collect()
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        out[name] = round(n / (time.perf_counter() - began))
    shutil.rmtree(root)
    return out


def main() -> None:
    from tickloom.session import build_session

    n, cpus = int(os.environ.get("SCALE_TICKS", "20000000")), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("scale", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(4 * int(cpus)), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    out = measure(spark, n)
    spark.stop()
    print(json.dumps({"ticks": n, "cpus": int(cpus), "ticks_per_second": out}))


if __name__ == "__main__":
    main()
