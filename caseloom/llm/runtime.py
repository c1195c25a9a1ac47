"""Helpers shared by the operators: shared checkpoints, table access, column checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this number of rows; beyond it, a shuffle join is used.
BROADCAST_ROWS = 100_000
#: A key is heavy if it holds more than one of so many shares of a partition's rows.
HEAVY_SHARE = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a temporary one for a driver that
    runs all tasks itself (tests); on a cluster RuntimeError, as executors share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="caseloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame, shrink: int = 1) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no rerun.

    shrink: write about one file for as many partitions; for tables that much smaller than
    what they are made from.  Each file costs the executors a few calls to the file system.
    """
    spark = df.sparkSession
    if shrink > 1:
        df = df.coalesce(max(8, partitions(spark) // shrink))
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    # files of a kept table go when nothing refers to it any more
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def planned_bytes(df: DataFrame) -> int:
    """Size of df as the planner knows it, from the sizes of files and tables; reads nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0  # unknown sizes are given as the largest number


def attach(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str = "copies", how: str = "inner") -> DataFrame:
    """rows joined with classes, which have one row for each value of keys and the number of rows
    of that value in `copies`; how: inner or left.

    Values that hold more than a small share of the rows are fewer than four times the number of
    partitions, whatever the size of the table: they are broadcast, so their rows stay where they
    are.  Only the others are dealt by their keys, and none of these is heavy.  Both tables are
    read twice and should be kept ones or cheap to read.
    """
    total = classes.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    bound = total // (HEAVY_SHARE * partitions(rows.sparkSession)) + 1
    heavy = classes.where(F.col(copies) > bound)
    few = F.broadcast(heavy)  # fewer than HEAVY_SHARE * partitions rows
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(classes.where(F.col(copies) <= bound), keys, how))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
