"""Access to the input tables by directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a scale-factor directory; any path that Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
