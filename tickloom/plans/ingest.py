"""From hour files to the store: decode, de-duplicate, validate, write, and one manifest row per request."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import market_open
from ..functions.text import EMPTY_SHA256
from ..operators.manifest import pending
from ..operators.quality import HARD, accepted, dedup, dedup_counts, issues, spread_stats
from ..schemas import TICKS
from ..sources.bi5 import hour_files, scan
from ..sources.requests import instant
from ..session import shared_dir
from ..sources.store import _exists, delete, files, listing, read_stored_manifest, write_manifest, write_ticks

KEY = ["pair", "date", "hour"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"date": F.to_date("hour_start"), "hour": F.hour("hour_start")}).drop("hour_start")


def ingest(spark: SparkSession, root: str, requests: DataFrame, out: str, fail_on_gap: bool = True) -> DataFrame:
    """Store the requested hours found below ``root`` and return the manifest.

    Decoded rows are read from the files again for statistics and for the write
    rather than cached; Spark's cache would have to hold all ticks. An hour with
    any hard issue is left out whole and is a gap; so is one that is missing or
    can't be decoded. Issues carry their reason, count and severity.
    """
    named = hour_files(spark, root, digest=True)
    raw = scan(spark, root)
    asked = requests.select(*KEY).distinct()
    rows = raw.withColumn("date", F.col("date").cast("date")).join(asked, KEY, "left_semi")
    broken = rows.where("error is not null").select(*KEY, "error")
    ticks = rows.where("seq is not null").select("pair", "hour_start", "ts", "bid", "ask", "bid_volume", "ask_volume", "seq")
    clean = dedup(ticks)
    found = issues(clean)
    kept = accepted(clean, found)
    write_ticks(kept.withColumn("source", F.lit("bi5")).select(*TICKS.names), out)
    stats = _keyed(spread_stats(clean, ["pair", "hour_start"]))
    spans = _keyed(clean.groupBy("pair", "hour_start").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    counts = _keyed(dedup_counts(ticks))
    listed = _keyed(found.groupBy("pair", "hour_start").agg(F.sort_array(F.collect_list(F.struct("reason", F.concat_ws(" ", F.lit("first at"), F.col("first_seq").cast("string")).alias("detail"), "count"))).alias("found"), F.max(F.col("reason").isin(*HARD)).alias("hard")))
    m = asked.join(named, KEY, "left").join(broken, KEY, "left").join(counts, KEY, "left").join(listed, KEY, "left").join(stats, KEY, "left").join(spans, KEY, "left")
    open_ = market_open(instant())
    status = (
        F.when(F.col("length").isNull() | F.col("error").isNotNull() | F.coalesce("hard", F.lit(False)), "gap").when(F.col("kept") > 0, "ok").when(open_, "empty").otherwise("closed")
    )

    def issue(reason: str, detail: Column) -> Column:
        return F.struct(F.lit(reason).alias("reason"), detail.alias("detail"), F.lit(1).cast("long").alias("count"))

    own = F.array_compact(F.array(
        F.when(F.col("length").isNull(), issue("FETCH_ERROR", F.lit("no file"))), F.when(F.col("error").isNotNull(), issue("DECODE_ERROR", F.col("error"))),
        F.when((F.col("length") >= 0) & F.col("error").isNull() & F.coalesce(F.col("kept") == 0, F.lit(True)) & open_, issue("EMPTY_TRADING_HOUR", F.lit("no ticks in an open hour"))),
    ))
    spread = F.when(F.col("ticks") > 0, F.struct("median_pips", F.col("mean_pips"), "p99_pips", "p99_9_pips", "max_pips"))
    hard = F.col("error").isNotNull() | F.coalesce("hard", F.lit(False)) | (F.col("length").isNull() & F.lit(fail_on_gap))
    return m.select(
        *KEY, status.alias("status"), F.coalesce("decoded", F.lit(0)).alias("decoded_ticks"), F.when(status == "ok", F.col("kept")).otherwise(F.lit(0)).alias("written_ticks"), F.coalesce("dropped", F.lit(0)).alias("duplicates_dropped"),
        F.when(F.col("length") == 0, F.lit(EMPTY_SHA256)).otherwise(F.col("sha256")).alias("sha256"), F.col("length").alias("compressed_bytes"), (F.col("decoded") * 20).alias("decoded_bytes"), F.col("path").alias("origin"),
        "first_ts", "last_ts", spread.alias("spread_pips"), F.concat(own, F.coalesce("found", F.array())).alias("issues"), F.coalesce(hard, F.lit(False)).alias("is_error"),
    )


def still_pending(spark: SparkSession, requests: DataFrame, out: str, manifest: str) -> DataFrame:
    """Requests that neither the manifest nor the store's files show as done."""
    settled = read_stored_manifest(spark, manifest)
    if settled is None:
        return requests
    stored = listing(files(spark, f"{out}/ticks")) if _exists(spark, f"{out}/ticks") else settled.select(*KEY).limit(0)
    return pending(requests, settled, stored)


def ingest_in_steps(spark: SparkSession, root: str, requests: DataFrame, out: str, manifest: str, days_per_step: int = 31, fail_on_gap: bool = True) -> Iterator[DataFrame]:
    """Ingest what is still pending, some days at a time; yields the manifest rows of each step.

    A step's ticks are written before its manifest rows, and both replace hours
    and not days, so a job that is stopped goes on where it was, and hours that
    were stored before stay. Only dates reach the driver.
    """
    todo = still_pending(spark, requests.select(*KEY).distinct(), out, manifest)
    days = [r["date"] for r in todo.select("date").distinct().orderBy("date").toLocalIterator()]
    for k in range(0, len(days), days_per_step):
        part = days[k : k + days_per_step]
        asked = todo.where(F.col("date").between(F.lit(part[0]), F.lit(part[-1])))
        work = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
        asked.write.parquet(f"{work}/asked")  # the step's own ticks must not change what it asks for
        ingest(spark, root, spark.read.parquet(f"{work}/asked"), out, fail_on_gap).write.parquet(f"{work}/rows")
        rows = spark.read.parquet(f"{work}/rows")
        write_manifest(rows, manifest)
        yield rows
        delete(spark, work)
