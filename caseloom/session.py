"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def share_code(spark: SparkSession | None = None) -> None:
    """Let Python workers on this machine import the package, wherever the driver was started.

    On a cluster the package is installed or shipped with --py-files; a path that does not exist
    there does no harm.
    """
    context = spark.sparkContext if spark else SparkContext._active_spark_context
    for env in (os.environ, context.environment if context else {}):
        parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in parts:
            env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])


def session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a temporary one for a driver that
    runs all tasks itself (tests); on a cluster RuntimeError, as executors share no such folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="caseloom-")
        context.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
