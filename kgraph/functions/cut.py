"""Cutting lineage of iterative plans, and the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder below the warehouse, or a temporary one if all runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        own = tempfile.mkdtemp(prefix="kgraph-ckpt-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kgraph-scratch"
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files that no frame needs any more are removed now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder.  Spark removes its files once the data is no longer referred to if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def store(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder as Parquet, which takes less of it than a checkpoint; stays, as the returned frame reads it."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df  # else its shuffles are still needed
    drop_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
