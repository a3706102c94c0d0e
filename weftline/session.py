"""Session settings and the folder where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution sizes and splits shuffle partitions at run time; UTC keeps results comparable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.scheduler.mode": "FAIR",
}


def session(app: str = "weftline", **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; dots in names of further settings are written as double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is, one is set (see below).

    In local mode that is a temporary folder, else one under the warehouse, which a cluster shares.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
            named = Path(named).as_uri()
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.weftline"
            if named.startswith(("file:", "/")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed now and stored reliably, so that later plans start from it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
