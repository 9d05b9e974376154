"""Line-delimited logs and documents: probes, ledger, sessions, chunks, manifests and candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rfc3339
from ..schemas import LEDGER, PROBES, Schema

OHLC = "struct<o:string,h:string,l:string,c:string>"
CANDLES = Schema(f"instrument string, granularity string, candles array<struct<time:string,complete:boolean,volume:bigint,bid:{OHLC},ask:{OHLC},mid:{OHLC}>>")
SESSIONS = Schema(
    "status string, level int, requests bigint, throttles bigint, seconds double, seconds_parked double, ticks bigint, hours_ok bigint, hours_empty bigint, hours_gap bigint, bar_seconds double, bar_dates_built bigint, ended_at string, "
    "calibration struct<final_level:int,windows:array<struct<level:int,rate:double,requests:bigint,seconds:double,throttles:bigint>>,transitions:array<struct<at:double,level:int,why:string>>>"
)


def read_lines(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Records of a log; a broken line, such as a truncated last one, is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, PROBES)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, SESSIONS)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger records; a line that is no record is kept as ``record = 'malformed'`` with its text."""
    df = spark.read.schema(LEDGER).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(path)
    return df.withColumn("record", F.when(F.col("malformed").isNotNull(), "malformed").otherwise(F.col("record")))


def read_manifest(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The hours of a manifest document; one that can't be parsed counts as absent."""
    df = spark.read.schema(f"hours array<{schema.struct.simpleString()}>").option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return df.select(F.explode("hours").alias("h")).select("h.*")


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candles of captured answers: string prices as doubles, instants cut to microseconds."""
    return candles(spark.read.schema(CANDLES).option("multiLine", "true").json(path))


def candles(documents: DataFrame) -> DataFrame:
    c = documents.select(F.regexp_replace("instrument", "_", "").alias("pair"), F.explode("candles").alias("c"))
    names = {"open": "o", "high": "h", "low": "l", "close": "c"}
    quotes = [F.col(f"c.{q}.{short}").cast("double").alias(f"{q}_{long}") for q in ("bid", "ask", "mid") for long, short in names.items()]
    return c.select("pair", rfc3339(F.col("c.time")).alias("ts"), F.coalesce("c.complete", F.lit(False)).alias("complete"), F.coalesce("c.volume", F.lit(0)).alias("volume"), *quotes)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_probes(probes: DataFrame, path: str) -> None:
    """Sorted mirror of the probe log, zstd."""
    probes.orderBy("pair", "date", "hour").write.mode("overwrite").option("compression", "zstd").parquet(path)


def throughput(sessions: DataFrame) -> DataFrame:
    """Requests, seconds, throttles and rates by concurrency level."""
    w = sessions.select(F.explode("calibration.windows").alias("w")).select("w.*")
    return w.groupBy("level").agg(F.sum("requests").alias("requests"), F.sum("seconds").alias("seconds"), F.sum("throttles").alias("throttles")).withColumns({"requests_per_second": F.round(F.col("requests") / F.col("seconds"), 6), "throttle_rate": F.round(F.col("throttles") / F.col("requests"), 6)})


def trials(ledger: DataFrame, card: str | None = None) -> DataFrame:
    """How many experiments were started, by task card."""
    starts = ledger.where("record = 'start'")
    return (starts.where(F.col("taskcard") == card) if card else starts).groupBy("taskcard").agg(F.count(F.lit(1)).alias("trials"))


def ordering_violations(ledger: DataFrame) -> DataFrame:
    """Ends without a start, or before the experiment's first start."""
    starts = ledger.where("record = 'start'").groupBy("experiment_id").agg(F.min("started_at").alias("first_start"))
    return ledger.where("record = 'end'").join(starts, "experiment_id", "left").where("first_start is null or ended_at < first_start").select("experiment_id", "ended_at", "first_start")


def harvest_costs(ledger: DataFrame) -> DataFrame:
    """Sums of the JSON counters inside the status texts of end records, by experiment."""
    counters = "completed bigint, throttles bigint, seconds double, seconds_parked double, outages_ridden_out bigint"
    j = F.from_json(F.regexp_extract("status", r"(\{.*)", 1), counters)
    ends = ledger.where("record = 'end'").select("experiment_id", j.alias("j")).where("j is not null")
    sums = [F.coalesce(F.sum(f"j.{c}"), F.lit(0)).alias(name) for c, name in (("completed", "probes"), ("throttles", "throttles"), ("seconds", "seconds"), ("seconds_parked", "parked"), ("outages_ridden_out", "outages"))]
    return ends.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("sessions"), *sums)
