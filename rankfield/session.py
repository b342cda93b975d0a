"""Shared-folder and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of the files behind a table that one task of a wide shuffle stands for, about.
TASK_BYTES = 4 << 20
# Rows of a table of a few short columns that is sent to every task, at most.
SENT_ROWS = 500_000

_fallback: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``. Only a local
    master, where every task runs on this machine, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="rankfield-")
    return _fallback[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and drop its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def sent(df: DataFrame) -> DataFrame:
    """``df``, materialised; joins send it to the other side's tasks, which stay as they are, where it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done, which it does once the driver's JVM has collected what
    referred to them; without this they lie on the disks until the driver happens to be short of memory."""
    spark.sparkContext._jvm.System.gc()


def tasks_for(df: DataFrame, task_bytes: int | None = None) -> int | None:
    """Tasks that a shuffle of ``df`` needs, so that none grows with the files it is read from; None where the
    session's number will do, or no files are known."""
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        return None
    sizes = spark.read.format("binaryFile").load(list(files)).agg(F.sum("length"))  # lists them, reads no content
    n = -(-int(sizes.first()[0] or 0) // (task_bytes or TASK_BYTES))
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, n: int | None, *keys: str | Column) -> DataFrame:
    """Rows dealt over ``n`` tasks by ``keys``, for the step by these keys that follows; None leaves that to the step."""
    return df.repartition(n, *keys) if n else df
