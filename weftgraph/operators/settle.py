"""Cutting a plan's lineage, and folders of our own, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset in local mode, as in tests, a folder of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weft-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the session ends."""
    path = f"{shared_folder(spark).rstrip('/')}/weft-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def settle(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
