"""Tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session of one machine that names none gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _on(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, removed when the driver's JVM ends."""
    path = f"{_base(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    files, hadoop_path = _on(spark, path)
    files.deleteOnExit(hadoop_path)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._settled_at = path
    return read


def released(*tables: DataFrame) -> None:
    """Removes settled tables that nothing will read again."""
    for df in tables:
        files, hadoop_path = _on(df.sparkSession, df._settled_at)
        files.delete(hadoop_path, True)


def freed(spark: SparkSession) -> None:
    """Has the driver look for what nothing refers to any more, so that shuffle files behind settled tables go at once, not at its next own collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
