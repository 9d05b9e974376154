"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "tickloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings that the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Set what can be set on a running session: the zone and the Parquet timestamp type."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset, and the
    master is a single machine, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each Spark context.

    Functions that run in Python workers are pickled by reference, so a worker
    must be able to import their module wherever it runs.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tickloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ship-")), "tickloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._tickloom_shipped = True
