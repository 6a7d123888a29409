"""Reading input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread_scan(scan: DataFrame) -> DataFrame:
    """Give a scan of fewer splits than cores a task for each core, and some more.

    Text analysis multiplies its input, so one split per core is the least it
    needs.  The number of tasks never falls: any other scan is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(2 * cores)
