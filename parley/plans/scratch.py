"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may do without: it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='parley-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: what is used more than once is computed once, and a lost executor costs nothing written."""
    path = f"{shared_dir(df.sparkSession)}/parley/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of the shared folder. For when every result is written: nothing read from them can be read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/parley")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
