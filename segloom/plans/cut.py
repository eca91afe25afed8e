"""Cutting lineage: a written table in the cluster's shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession):
    """Executions started inside drop their shuffle files at their end: what they wrote replaces them."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a single machine without one, a new folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a result feeds several branches: each would otherwise recompute it. The table
    outlives lost executors, keeps column pruning, and its file sizes let Spark choose joins. The shuffle files behind it
    go as soon as it stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segloom/{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
