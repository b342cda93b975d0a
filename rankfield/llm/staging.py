"""Tables between the steps of an operator, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master, where every task runs on this machine,
    may leave it unset; a cluster without it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="rankfield-llm-")
    return _own[sc.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sampled(df: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows of ``df``, all where there are fewer: those whose 64-bit hash ``key`` falls into a
    share of all hashes. Needs a count only, sorts nothing and does not depend on the partitioning."""
    parts = 1_000_000_007
    n = df.count()
    if n <= size:
        return df
    return df.filter(F.pmod(F.col(key), F.lit(parts)) < int(parts * size / n))
