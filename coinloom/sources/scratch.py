"""Written intermediates in the folder that the cluster shares, removed when the application ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one only where that is unset and executors are local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder its executors share")
        base = "file://" + tempfile.mkdtemp(prefix="coinloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/coinloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may already be gone; the folder is scratch
        pass


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """df written and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
