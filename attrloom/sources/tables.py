"""Parquet tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.operators.lookups import stored_bytes

# Stored bytes beyond which a table is shuffled only if it would leave most cores idle.
SPREAD_BYTES = 256 << 20


def filled_tasks(df: DataFrame, enough: int) -> int:
    """Read tasks that get rows. A split without the start of a row group is empty, so where the files alone are not
    ``enough`` a scan without columns counts the others."""
    tasks = df.rdd.getNumPartitions()
    if tasks < enough or len(df.inputFiles()) >= enough:
        return tasks
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """A file scan spread over the cores when its files give fewer read tasks than there are cores.

    The operators behind it are bound by CPU per row, so a small file with one row group must not pin
    them to one core. A table with enough filled splits, or of more than ``SPREAD_BYTES`` that occupies more than
    a quarter of the cores, is read as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = filled_tasks(df, cores)
    if tasks >= cores or (stored_bytes(df) > SPREAD_BYTES and tasks * 4 > cores):
        return df
    return df.repartition(cores, *columns)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, spread over the cores when it is small."""
    return spread(spark.read.parquet(path))
