"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SPREAD = 1 << 30  # bytes


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One of up to MOST_SPREAD bytes in fewer splits than the cluster has cores, such as a file of a single
    row group, is spread over them, as scans take longer than the shuffle of so little; others are read as they are."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores or int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > MOST_SPREAD:
        return table
    return table.repartition(cores).where(F.spark_partition_id() >= 0)  # always so, but filters are not moved below the shuffle past it
