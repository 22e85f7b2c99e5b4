"""Tables that several jobs of one operator read, written below the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local default only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/quillmark-kept-{os.getuid()}"
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what is computed once isn't computed again by each plan that uses it, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/quillmark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(df: DataFrame) -> int:
    """Partitions of a shuffle: rows that are few and about to become many are dealt to as many tasks, which adaptive execution would else join to one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
