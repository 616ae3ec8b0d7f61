"""Cutting lineage between rounds of an iteration, and dealing rows over tasks of a size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local master may do without it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = tempfile.mkdtemp(dir="/tmp/checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: partitions and the order of their rows stay."""
    shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back: computed once, where a checkpoint computes it twice, but partitions
    may be other ones."""
    spark = df.sparkSession
    path = f"{shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt by the keys over ``tasks`` tasks, where these are more than a shuffle has anyway. Groupings by these keys and
    others need no further shuffle."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
