"""The shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir where the cluster names it; a temporary folder on a single machine (tests).

    On a cluster without that setting it is an error: a local folder isn't shared.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="slantframe-"))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for rows that are few but much work, which Spark would gather in one task by their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and nothing is worked out twice (a checkpoint works it out for its count and for its files)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
