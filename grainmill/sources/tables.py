"""Parquet tables by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Inputs of at most so many bytes, as the plan estimates them, may be moved to use more cores.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many partitions as there are cores, where a small input has fewer: a small file is one task otherwise. Large inputs stay as they are read, in splits of spark.sql.files.maxPartitionBytes."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_INPUT:
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table whose rows cost much to work on."""
    return spread(table(spark, folder, name))
